"""Scalar functions on columns: sizes, modes, times, paths, names and codes.

Texts with one or two decimals are rounded on the exact binary value, ties to even, as C's
``printf`` does: 0.25 gives 0.2, 0.35 gives 0.3.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkloom.model import plain_path, strip

#: Upper bound in MiB (exclusive) and name of each chunker profile, the last without bound (fixed values).
PROFILE_BOUNDS = [(20, "1M"), (40, "4M"), (80, "8M"), (160, "16M"), (320, "32M")]
PROFILE_TOP = "64M"
#: Compression algorithms by id, and other names for them (fixed values).
ALGORITHMS = {0: "none", 1: "lz4", 2: "zstd", 3: "zlib", 4: "lzma", 5: "xz"}
ALIASES = {"zstandard": "zstd", "deflate": "zlib"}
#: How the name of an archive begins that was given none (fixed value).
UNNAMED = "backup_archive_ptintime_"
#: Level of compression where none is named (fixed value).
DEFAULT_LEVEL = 6
#: Parity shards of 16 data shards by redundancy (fixed values).
PARITY = {"low": 1, "medium": 2, "high": 4}
#: Letters of item types, and other names of types in a search (fixed values).
TYPE_LETTERS = {"File": "f", "Directory": "d", "Symlink": "l", "Hardlink": "h", "BlockDevice": "b", "CharDevice": "c", "Fifo": "p", "Socket": "s"}
TYPE_NAMES = {"f": "File", "file": "File", "d": "Directory", "dir": "Directory", "directory": "Directory", "l": "Symlink", "link": "Symlink", "symlink": "Symlink", "h": "Hardlink", "hardlink": "Hardlink"}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(values: dict, key: Column, default: Column | None = None) -> Column:
    """The value of a small fixed table; ``default`` or null for other keys."""
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), default if default is not None else F.lit(None))


def decimals(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals of a non-negative double, rounded on its exact value, ties to even.

    The value times twice the scale is held as a product and its rounding error (Dekker's split),
    so it is compared exactly with the odd number half-way between the two candidates.
    """
    v = value.cast("double")
    twice = float(2 * 10**digits)
    low = F.floor(v * float(10**digits))
    middle = (low * 2 + 1).cast("double")
    spread = v * 134217729.0
    high = spread - (spread - v)
    product = v * twice
    error = (high * twice - product) + (v - high) * twice
    up = (product > middle) | ((product == middle) & ((error > 0) | ((error == 0) & (low % 2 == 1))))
    n = low + F.when(up, 1).otherwise(0)
    return F.concat(F.floor(n / F.lit(10**digits)).cast("string"), F.lit("."), F.lpad((n % F.lit(10**digits)).cast("string"), digits, "0"))


def _scaled(size: Column, units: list[str], digits: int, plain: str) -> Column:
    out = F.concat(size.cast("string"), F.lit(plain))
    for power, unit in enumerate(units, 1):
        bound = 1024**power
        out = F.when(size >= bound, F.concat(decimals(size / float(bound), digits), F.lit(unit))).otherwise(out)
    return out


def human_bytes(size: Column | str) -> Column:
    """``512 B``, then ``1.5 KB`` up to TB."""
    return _scaled(_c(size), [" KB", " MB", " GB", " TB"], 1, " B")


def list_size(size: Column | str) -> Column:
    """``512B``, then ``1.5K`` up to T."""
    return _scaled(_c(size), ["K", "M", "G", "T"], 1, "B")


def search_size(size: Column | str) -> Column:
    """As ``list_size``, but no unit above G."""
    return _scaled(_c(size), ["K", "M", "G"], 1, "B")


def diff_size(size: Column | str) -> Column:
    """``512 B``, then ``1.50 KB`` up to TB."""
    return _scaled(_c(size), [" KB", " MB", " GB", " TB"], 2, " B")


def signed_size(size: Column | str) -> Column:
    """``diff_size`` with its sign."""
    c = _c(size)
    return F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("+")), diff_size(F.abs(c)))


def duration(seconds: Column | str) -> Column:
    """``5.0s``, ``2.5m`` from a minute on, ``1.5h`` from an hour on."""
    c = _c(seconds)
    return F.when(c < 60, F.concat(decimals(c, 1), F.lit("s"))).when(c < 3600, F.concat(decimals(c / 60.0, 1), F.lit("m"))).otherwise(F.concat(decimals(c / 3600.0, 1), F.lit("h")))


def parse_size(text: Column | str) -> Column:
    """Bytes of ``10``, ``1.5K``, ``2MB``: units of 1024, decimals cut, below 0 gives 0, else null."""
    t = F.upper(strip(_c(text)))
    shape = r"\A([+-]?[0-9]*\.?[0-9]+\.?)([TGMK]?)B?\z"
    number = F.regexp_extract(t, shape, 1).try_cast("double")
    factor = lookup({"": 1.0, "K": 1024.0, "M": 1024.0**2, "G": 1024.0**3, "T": 1024.0**4}, F.regexp_extract(t, shape, 2))
    return F.when(t.rlike(shape), F.greatest(F.floor(number * factor), F.lit(0)).cast("bigint"))


def parse_day(text: Column | str) -> Column:
    """Epoch seconds of midnight UTC of ``YYYY-MM-DD``, null of anything else."""
    t = _c(text)
    return F.when(t.rlike(r"\A\d{4}-\d\d-\d\d\z"), F.unix_date(t.try_cast("date")).cast("bigint") * 86400)


def type_name(text: Column | str) -> Column:
    return lookup(TYPE_NAMES, F.lower(_c(text)))


def type_letter(item_type: Column | str, file_as: str = "f") -> Column:
    """Letter of an item type; lists show files as ``-``."""
    return lookup(TYPE_LETTERS | {"File": file_as}, _c(item_type), F.lit("?"))


def mode_text(mode: Column | str) -> Column:
    """``rwxr-xr-x`` of the lowest nine bits."""
    c = _c(mode)
    return F.concat(*[F.when(c.bitwiseAND(F.lit(1 << (8 - i))) != 0, F.lit("rwx"[i % 3])).otherwise(F.lit("-")) for i in range(9)])


def epoch_text(seconds: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Time of epoch seconds, ``unknown`` outside of the years 1 to 9999."""
    c = _c(seconds)
    return F.when(c.between(-62135596800, 253402300799), F.date_format(F.timestamp_seconds(c), pattern)).otherwise("unknown")


def http_date(text: Column | str) -> Column:
    """Epoch seconds of an RFC 2822 date (``Wed, 21 Oct 2015 07:28:00 GMT`` or with an offset), null if unreadable."""
    t = strip(_c(text))
    shape = r"\A(?:[A-Za-z]{3}, *)?(\d{1,2}) ([A-Za-z]{3}) (\d{4}) (\d\d:\d\d:\d\d) (GMT|UTC|UT|Z|[+-]\d{4})\z"
    months = {m: f"{i:02d}" for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
    part = [F.regexp_extract(t, shape, i) for i in range(1, 6)]
    zone = F.when(part[4].rlike(r"\A[+-]"), F.concat(F.substring(part[4], 1, 3), F.lit(":"), F.substring(part[4], 4, 2))).otherwise("Z")
    iso = F.concat(part[2], F.lit("-"), lookup(months, F.lower(part[1])), F.lit("-"), F.lpad(part[0], 2, "0"), F.lit("T"), part[3], zone)
    return F.when(t.rlike(shape), F.unix_seconds(iso.try_cast("timestamp")))


def percent_decode(text: Column | str) -> Column:
    """``%XX`` as the character of that number; every other byte of the text likewise, ``+`` as it is.

    So text beyond ASCII comes out as the Latin-1 reading of its UTF-8 bytes, and malformed
    escapes stay.
    """
    t = _c(text)
    # one element per escape or single byte character of the Latin-1 reading
    latin = F.decode(F.encode(t, "UTF-8"), "ISO-8859-1")
    parts = F.regexp_extract_all(latin, F.lit(r"(?s)%[0-9A-Fa-f]{2}|."), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(F.length(p) == 3, F.decode(F.unhex(F.substring(p, 2, 2)), "ISO-8859-1")).otherwise(p)), "")


def normal_href(text: Column | str) -> Column:
    """A link without its query, decoded, without trailing ``/``; ``/`` if nothing is left."""
    t = F.regexp_replace(percent_decode(F.regexp_replace(_c(text), r"(?s)\?.*\z", "")), r"/+\z", "")
    return F.when(t == "", "/").otherwise(t)


def normal_path(text: Column | str) -> Column:
    """A path of a WebDAV root: trimmed, with a leading slash, and without one trailing slash unless it is all."""
    t = F.trim(_c(text))
    t = F.when(t.startswith("/"), t).otherwise(F.concat(F.lit("/"), t))
    return F.when((F.length(t) > 1) & t.endswith("/"), F.regexp_replace(t, r"/\z", "")).otherwise(t)


def relative_path(path: Column | str) -> Column:
    """The path's normal components: without root, ``.`` and ``..``."""
    return F.array_join(F.filter(F.split(_c(path), "/", -1), lambda x: ~x.isin("", ".", "..")), "/")


def profile(size: Column | str) -> Column:
    """Chunker profile of a file of that many bytes, by whole MiB."""
    mib, out = F.floor(_c(size) / F.lit(1 << 20)), F.lit(PROFILE_TOP)
    for bound, name in reversed(PROFILE_BOUNDS):
        out = F.when(mib < bound, F.lit(name)).otherwise(out)
    return F.when(mib.isNotNull(), out)


#: Least, mean and greatest chunk size of each profile in KiB (fixed values).
PROFILE_KIB = {
    "1M": (256, 1024, 4096),
    "4M": (1024, 4096, 16384),
    "8M": (2048, 8192, 32768),
    "16M": (4096, 16384, 65536),
    "32M": (8192, 32768, 65536),
    "64M": (16384, 49152, 65536),
}


def profile_sizes(name: str) -> tuple[int, int, int]:
    """(least, mean, greatest) chunk bytes of a profile."""
    least, mean, greatest = PROFILE_KIB[name]
    return least << 10, mean << 10, greatest << 10


def check_sizes(least: int, mean: int, greatest: int) -> None:
    """Raises unless 0 < least <= mean <= greatest."""
    if not 0 < least <= mean <= greatest:
        raise ValueError(f"chunk sizes out of order: {least}, {mean}, {greatest}")


def compression_ratio(out: Column | str, size: Column | str) -> Column:
    """Share of the size that is left; 1 of nothing."""
    return F.when(_c(size) > 0, _c(out) / _c(size)).otherwise(1.0)


def algorithm_name(text: Column | str) -> Column:
    """Plain name of a compression algorithm, null if there is none of that name."""
    t = F.lower(strip(_c(text)))
    known = {n: n for n in ALGORITHMS.values()} | ALIASES
    return lookup(known, t)


def compression_spec(text: Column | str) -> Column:
    """``algo,level`` as struct(algorithm, level).

    No text and ``none`` stand for the default, zstd at level 6; other unknown names are zstd, a level that
    is missing or no number up to 255 is 3, and one above 9 is 6.
    """
    t = F.coalesce(_c(text), F.lit(""))
    parts = F.split(t, ",", -1)
    written = F.get(parts, F.lit(1))
    given = F.when(written.rlike(r"\A\+?\d{1,9}\z"), written.try_cast("int"))
    level = F.when(given <= 9, given).when(given <= 255, F.lit(DEFAULT_LEVEL)).otherwise(F.lit(3))
    plain = t.isin("", "none")
    algorithm = F.when(plain, "zstd").otherwise(F.coalesce(algorithm_name(F.get(parts, F.lit(0))), F.lit("zstd")))
    return F.struct(algorithm.alias("algorithm"), F.when(plain, DEFAULT_LEVEL).otherwise(level).alias("level"))


def parity_shards(redundancy: Column | str) -> Column:
    """Parity shards of 16 data shards; none for other names."""
    return lookup(PARITY, F.lower(_c(redundancy)), F.lit(0))


def parity_bytes(size: Column, shards: Column) -> Column:
    """Bytes of the parity blob of an object: header, 16 checksums, and the shards of a sixteenth each, rounded up."""
    return F.when(shards > 0, F.lit(16 + 16 * 4) + shards * F.ceil(size / F.lit(16))).otherwise(0).cast("bigint")


def csv_list(text: Column | str) -> Column:
    """Entries of comma text, trimmed, without empty ones; null if none is left."""
    found = F.filter(F.transform(F.split(_c(text), ",", -1), strip), lambda x: x != "")
    return F.when(F.size(found) > 0, found)


def path_list(text: Column | str) -> Column:
    """Entries of a JSON list if the text opens with ``[`` and is one, else of comma text."""
    t = _c(text)
    return F.coalesce(F.when(t.startswith("["), F.from_json(t, "array<string>")), csv_list(t))


def archive_name(template: Column | str, host: Column, now: Column) -> Column:
    """The template with ``{hostname}``, ``{now}`` and ``{now:%Y...}`` filled in."""
    t = F.replace(F.replace(_c(template), F.lit("{hostname}"), host), F.lit("{now}"), F.date_format(now, "yyyy-MM-dd_HH:mm:ss"))
    codes = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss"}
    given = F.regexp_extract(t, r"\{now:([^}]*)\}", 1)
    filled = given
    for code, pattern in codes.items():
        filled = F.replace(filled, F.lit(code), F.date_format(now, pattern))
    return F.when(given != "", F.replace(t, F.concat(F.lit("{now:"), given, F.lit("}")), filled)).otherwise(t)


def unique_archive_name(host: Column, user: Column, now: Column) -> Column:
    """Name of an archive that got none: host, user and the time to a thousandth of a second."""
    return F.concat(F.lit(UNNAMED), host, F.lit("_"), user, F.lit("_"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def task_name(repo: Column, archive: Column, frequency: Column, hour: Column, minute: Column) -> Column:
    """``repo_archive_freq_HH_MM`` in lower case, blanks as ``_``."""
    return F.replace(F.lower(F.format_string("%s_%s_%s_%02d_%02d", repo, archive, frequency, hour, minute)), F.lit(" "), F.lit("_"))


def next_weekday(day: Column, weekday: Column) -> Column:
    """The next date from ``day`` on that falls on ``weekday`` (0 is Monday, 6 and above Sunday)."""
    return F.date_add(day, F.pmod(F.least(weekday, F.lit(6)) - F.weekday(day), F.lit(7)).cast("int"))


def day_in_month(day: Column, day_of_month: Column) -> Column:
    """That day of ``day``'s month, from the first to the month's last."""
    first = F.trunc(day, "month")
    return F.date_add(first, (F.least(F.greatest(day_of_month, F.lit(1)), F.dayofmonth(F.last_day(day))) - 1).cast("int"))


#: Remote addresses: with a scheme, and short with the path behind the last colon.
SSH_ADDRESS = r"ssh://(?:([^@/]*)@)?([^:/@]+)(?::(\d+))?(/(?s:.*))"
SSH_SHORT = r"(?:([^@:]*)@)?((?!ssh://)(?s:.*)):([^:]*)"


def parse_location(text: str) -> dict[str, object]:
    """Kind, host, port, user and path of ``ssh://user@host:port/path`` or ``user@host:path``, the user may be missing; else a local path.

    The driver's form of ``location``.
    """
    m = re.fullmatch(SSH_ADDRESS, text) or re.fullmatch(SSH_SHORT, text)
    if not m:
        return {"kind": "local", "path": text}
    found = m.groups()
    return {"kind": "ssh", "user": found[0], "host": found[1], "port": int(found[2] or 22) if len(found) == 4 else 22, "path": found[-1]}


def location(text: Column | str) -> Column:
    """struct(kind, user, host, port, path) of a remote address; anything without a colon is a local path."""
    t = _c(text)

    def part(shape: str, n: int) -> Column:
        return F.nullif(F.regexp_extract(t, shape, n), F.lit(""))

    long, short = t.rlike(rf"\A{SSH_ADDRESS}\z"), t.rlike(rf"\A{SSH_SHORT}\z") & ~t.startswith("ssh://")
    fields = [F.when(long, part(rf"\A{SSH_ADDRESS}\z", a)).when(short, part(rf"\A{SSH_SHORT}\z", b)) for a, b in ((1, 1), (2, 2), (4, 3))]
    port = F.when(long, F.coalesce(part(rf"\A{SSH_ADDRESS}\z", 3).cast("int"), F.lit(22))).when(short, 22)
    kind = F.when(long | short, "ssh").otherwise("local")
    return F.when(t.isNotNull(), F.struct(kind.alias("kind"), fields[0].alias("user"), fields[1].alias("host"), port.alias("port"), F.when(long | short, fields[2]).otherwise(t).alias("path")))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "re", "Column", "F", "strip", "plain_path")]
