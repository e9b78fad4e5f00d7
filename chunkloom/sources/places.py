"""Where a repository lies: local folders, WebDAV and S3 places and their credentials."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit, urlunsplit

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Schemes of WebDAV and S3 places (fixed values).
WEBDAV = {"dav": "http", "webdav": "http", "davs": "https", "webdavs": "https", "http": "http", "https": "https"}
S3 = {"s3": "https", "s3s": "https"}


@dataclass(frozen=True)
class Place:
    """A parsed place; ``root`` is a path, or the prefix within ``bucket``."""

    kind: str
    root: str
    endpoint: str | None = None
    bucket: str | None = None
    user: str | None = None
    secret: str | None = None


def parse_place(text: str) -> Place:
    """The place a text names. ``http(s)`` with user data names an S3-like endpoint, else WebDAV."""
    scheme = text.split("://", 1)[0].lower() if "://" in text else ""
    if scheme in S3:
        rest, _, prefix = text.split("://", 1)[1].partition("/")
        data, _, bucket = rest.rpartition("@")
        user, _, secret = data.partition(":")
        return Place("s3", prefix.strip("/"), None, bucket, unquote(user) or None, unquote(secret) or None)
    if scheme not in WEBDAV:
        return Place("local", text)
    u = urlsplit(text)
    host = (u.hostname or "") + (f":{u.port}" if u.port else "")
    user, secret = (unquote(x) if x else None for x in (u.username, u.password))
    if scheme in ("http", "https") and u.username:
        bucket, _, prefix = u.path.strip("/").partition("/")
        return Place("s3", prefix, f"{scheme}://{host}", bucket, user, secret)
    return Place("webdav", u.path or "/", f"{WEBDAV[scheme]}://{host}", None, user, secret)


def with_credentials(text: str, user: str | None = None, secret: str | None = None) -> str:
    """A WebDAV address with a scheme and the credentials in it; S3 addresses stay as they are."""
    if text.startswith("s3://"):
        return text
    u = urlsplit(text if "://" in text else f"https://{text}")
    if user and "@" not in u.netloc:
        u = u._replace(netloc=f"{user}:{secret}@{u.netloc}" if secret else f"{user}@{u.netloc}")
    return urlunsplit(u)


def with_credentials_column(text: str, user: str, secret: str) -> Column:
    """``with_credentials`` as an expression on a column of addresses."""
    c = F.col(text)
    full = F.when(c.contains("://"), c).otherwise(F.concat(F.lit("https://"), c))
    known = F.regexp_extract(full, r"\A[^:]*://([^/]*)", 1).contains("@")
    data = f"{user}:{secret}@".replace("\\", "\\\\").replace("$", "\\$")
    return F.when(c.startswith("s3://") | known, F.when(c.startswith("s3://"), c).otherwise(full)).otherwise(F.regexp_replace(full, r"\A([^:]*://)", "$1" + data))


def s3_settings(place: Place, env: Mapping[str, str] = os.environ, **given: str) -> dict[str, str]:
    """Hadoop settings of an S3 place: what is given comes first, then the place, then ``S3_*`` of the environment."""
    key = given.get("access_key") or place.user or env.get("S3_ACCESS_KEY") or env.get("S3_ACCESS_KEY_ID")
    secret = given.get("secret_key") or place.secret or env.get("S3_SECRET_KEY") or env.get("S3_SECRET_ACCESS_KEY")
    token = given.get("session_token") or env.get("S3_SESSION_TOKEN") or env.get("AWS_SESSION_TOKEN")
    endpoint = given.get("endpoint") or place.endpoint or env.get("S3_ENDPOINT")
    found = {"fs.s3a.access.key": key, "fs.s3a.secret.key": secret, "fs.s3a.session.token": token, "fs.s3a.endpoint": endpoint, "fs.s3a.path.style.access": "true" if endpoint else None}
    return {k: v for k, v in found.items() if v}


def hadoop_path(spark: SparkSession, text: str, **given: str) -> str:
    """The path under which Spark reads the place; S3 settings are put into the session."""
    place = parse_place(text)
    if place.kind == "s3":
        for name, value in s3_settings(place, **given).items():
            spark.sparkContext._jsc.hadoopConfiguration().set(name, value)
        return f"s3a://{place.bucket}/{place.root}"
    if place.kind == "webdav":
        raise NotImplementedError("WebDAV has no Hadoop file system: list it with chunkloom.sources.webdav")
    return f"file://{os.path.abspath(place.root)}"


def place_columns(text: Column | str) -> Column:
    """struct(kind, host, root) of places without user data, as an expression."""
    c = F.col(text) if isinstance(text, str) else text
    scheme = F.lower(F.regexp_extract(c, r"\A([A-Za-z0-9]+)://", 1))
    kind = F.when(scheme.isin(*S3), "s3").when(scheme.isin(*WEBDAV), "webdav").otherwise("local")
    host = F.regexp_extract(c, r"\A[A-Za-z0-9]+://(?:[^@/]*@)?([^/]*)", 1)
    rest = F.regexp_extract(c, r"\A[A-Za-z0-9]+://[^/]*(.*)\z", 1)
    root = F.when(kind == "local", c).when(kind == "s3", F.btrim(rest, F.lit("/"))).otherwise(F.when(rest == "", "/").otherwise(rest))
    return F.when(c.isNotNull(), F.struct(kind.alias("kind"), host.alias("host"), root.alias("root")))
