"""Catalog reads: searching items, listing archives and items, totals.

Every limit is taken after a total order, so results are deterministic. Pattern tests that are
null because a column is null reject the row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions.patterns import search_glob_regex
from chunkloom.model import distinct_archives
from chunkloom.operators.ranking import numbered
from chunkloom.session import small_side


def distinct_items(items: DataFrame) -> DataFrame:
    """Items without second deliveries; rows without an item_id stay.

    Few rows come twice, so nothing is gained by aggregating before the shuffle: rows are
    partitioned first and sorted once. Rows without an id are spread by a number of their own.
    """
    own = F.when(F.col("item_id").isNull(), F.monotonically_increasing_id()).alias("_own")
    return items.select("*", own).repartition("item_id", "_own").dropDuplicates(["item_id", "_own"]).drop("_own")


def under(path: Column | str, *roots: str) -> Column:
    """Whether a path is one of the roots or below it, by whole components; no root keeps all."""
    path = F.col(path) if isinstance(path, str) else path
    test = F.lit(not roots)
    for root in roots:
        root = root.rstrip("/")
        test = test | (path == root) | path.startswith(root + "/")
    return test


def path_order(path: Column | str = "path") -> Column:
    """Sort key that compares paths by components: ``a/b`` comes before ``a-b``."""
    return F.split(path, "/", -1)


@dataclass(frozen=True)
class SearchQuery:
    """Conditions of a search, all of them optional; exact beats glob beats substring, all without regard to case."""

    substring: str | None = None
    exact: str | None = None
    glob: str | None = None
    item_type: str | None = None
    min_size: int | None = None
    max_size: int | None = None
    modified_after: int | None = None
    modified_before: int | None = None
    archive: str | None = None
    limit: int | None = None

    def condition(self) -> Column:
        path, mtime, test = F.lower("path"), F.col("attrs.mtime"), F.lit(True)
        if self.exact is not None:
            test = test & (path == self.exact.lower())
        elif self.glob is not None:
            test = test & path.rlike(search_glob_regex(self.glob.lower()))
        elif self.substring is not None:
            test = test & path.contains(self.substring.lower())
        for value, column, at_least in ((self.min_size, F.col("size"), True), (self.max_size, F.col("size"), False), (self.modified_after, mtime, True), (self.modified_before, mtime, False)):
            if value is not None:
                test = test & (column >= value if at_least else column <= value)
        if self.item_type is not None:
            test = test & (F.col("item_type") == self.item_type)
        if self.archive is not None:
            test = test & (F.col("archive_name") == self.archive)
        return test


def search(items: DataFrame, archives: DataFrame, query: SearchQuery) -> DataFrame:
    """Items that meet the query: newest archive first, then name and path by bytes.

    A limit of 0 gives one row, as a limit is only looked at once a row is found.
    """
    hits = distinct_items(items.where(query.condition()).select("item_id", "archive_name", "path", "item_type", "size", F.col("attrs.mtime").alias("mtime")))
    found = hits.join(distinct_archives(archives).select("archive_name", "archive_time"), "archive_name").select("archive_name", "archive_time", "item_id", "path", "item_type", "size", "mtime")
    if query.limit is None:
        return found
    return found.orderBy(F.col("archive_time").desc(), "archive_name", "path", "item_id").limit(max(query.limit, 1))


def browse(items: DataFrame, pattern: str, *, regex: bool = False, root: str | Column = "") -> DataFrame:
    """Items whose path below ``root`` holds the pattern, with regard to case, or meets it as a regex.

    A regex that can't be read filters nothing.
    """
    full = F.concat_ws("/", F.lit(root) if isinstance(root, str) else root, "path") if not isinstance(root, str) or root else F.col("path")
    if not regex:
        return items.where(full.contains(pattern))
    try:
        items.sparkSession._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return items
    return items.where(full.rlike(pattern))


def head_then_tail(df: DataFrame, order: list[tuple[str, bool]], first: int | None, last: int | None) -> DataFrame:
    """The first rows in order, given as (column, descending) pairs, then the last of what remains."""
    if first is not None:
        df = df.orderBy(*_sorted(order)).limit(first)
    if last is not None:
        df = df.orderBy(*_sorted(order, flip=True)).limit(last)
    return df


def _sorted(order: list[tuple[str, bool]], *, flip: bool = False) -> list[Column]:
    """Sort keys of (column, descending) pairs, nulls as the least values."""
    return [F.col(c).desc_nulls_last() if down != flip else F.col(c).asc_nulls_first() for c, down in order]


def list_archives(archives: DataFrame, sort: str = "time", contains: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Archives by name, or else newest first; ``contains`` heeds case."""
    rows = distinct_archives(archives)
    if contains is not None:
        rows = rows.where(F.col("archive_name").contains(contains))
    order = [("archive_name", False)] if sort == "name" else [("archive_time", True), ("archive_name", False)]
    return head_then_tail(rows, order, first, last)


def list_items(items: DataFrame, roots: tuple[str, ...] = (), include: str | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Items below the roots whose path holds ``include`` and none of ``exclude``, without regard to case."""
    path, test = F.lower("path"), under("path", *roots)
    if include is not None:
        test = test & path.contains(include.lower())
    for pattern in exclude:
        test = test & ~path.contains(pattern.lower())
    return distinct_items(items.where(test))


def ranked_items(items: DataFrame, sort: str) -> DataFrame:
    """``n_in_order`` of each item within its archive: by size or mtime, largest first, or by path components.

    Equal items keep their order in the archive.
    """
    key, down = {"size": (F.col("size"), True), "mtime": (F.col("attrs.mtime"), True), "path": (path_order(), False)}[sort]
    ranked = numbered(items.withColumn("_key", key), ["archive_name"], [("_key", down), ("item_id", False)], "n_in_order")
    return ranked.withColumn("n_in_order", F.col("n_in_order").cast("int")).drop("_key")


def item_totals(items: DataFrame) -> DataFrame:
    """Per archive: files, directories, and the size of all items, hardlinks included."""
    return items.groupBy("archive_name").agg(F.count_if(F.col("item_type") == "File").alias("n_files"), F.count_if(F.col("item_type") == "Directory").alias("n_directories"), F.sum("size").alias("total_size"))


def catalog_totals(items: DataFrame, archives: DataFrame) -> DataFrame:
    """One row: archives, files, directories and size of the whole catalog."""
    n = distinct_archives(archives).agg(F.count(F.lit(1)).alias("n_archives"))
    t = items.agg(F.count_if(F.col("item_type") == "File").alias("n_files"), F.count_if(F.col("item_type") == "Directory").alias("n_directories"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))
    return n.crossJoin(t)  # one row each


def latest_archive(archives: DataFrame) -> DataFrame:
    """The newest archive per repository; of equal times the greatest name."""
    return distinct_archives(archives).groupBy("repo_path").agg(F.max(F.struct("archive_time", "archive_name")).alias("a")).select("repo_path", "a.archive_name", "a.archive_time")


def load_archive(items: DataFrame, archives: DataFrame, name: str) -> DataFrame:
    """Items of the named archive; raises if it is not registered."""
    if not archives.where(F.col("archive_name") == name).limit(1).count():
        raise LookupError(f"archive not found: {name}")
    return distinct_items(items.where(F.col("archive_name") == name))


def with_exact_path(items: DataFrame, path: str) -> DataFrame:
    """Items of exactly that path, with regard to case; no path keeps all."""
    return items if path == "" else items.where(F.col("path") == path)


def at_defaults(items: DataFrame, archives: DataFrame) -> DataFrame:
    """Items at or below one of the paths their archive was made from; all items of an archive that names none.

    Items of archives that are not registered are left out. Paths are compared as written, component by component.
    """
    roots = archives.where(F.col("archive_name").isNotNull()).groupBy("archive_name").agg(F.max("original_paths").alias("_roots"))
    held = items.join(small_side(roots), "archive_name")
    below = F.exists("_roots", lambda r: (F.col("path") == r) | F.col("path").startswith(F.concat(F.rtrim(r, F.lit("/")), F.lit("/"))))
    return held.where(F.col("_roots").isNull() | below).drop("_roots")


def first_shown(items: DataFrame, n: int = 4096) -> DataFrame:
    """The first ``n`` items of each archive in archive order, as a content view loads them."""
    return items.withColumn("n", F.row_number().over(Window.partitionBy("archive_name").orderBy("item_id"))).where(F.col("n") <= n)


def recent_files(items: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` files of each archive that were processed last, latest first."""
    files = items.where(F.col("item_type") == "File")
    return files.withColumn("n", F.row_number().over(Window.partitionBy("archive_name").orderBy(F.col("item_id").desc()))).where(F.col("n") <= n)


def restore_order(items: DataFrame) -> DataFrame:
    """(archive_name, item_id, path, restore_pass, restore_rank): hardlinks in a second pass, else by path components."""
    late = F.when(F.col("item_type") == "Hardlink", 2).otherwise(1)
    kept = items.where(F.col("item_type").isin("File", "Directory", "Symlink", "Hardlink")).select("archive_name", "item_id", "path", late.alias("restore_pass"), path_order().alias("_key"))
    ranked = numbered(kept, ["archive_name"], [("restore_pass", False), ("_key", False), ("item_id", False)], "restore_rank")
    return ranked.withColumn("restore_rank", F.col("restore_rank").cast("int")).drop("_key")


def restore_totals(items: DataFrame) -> DataFrame:
    """Per archive: count and bytes of its files proper."""
    files = F.col("item_type") == "File"
    return items.groupBy("archive_name").agg(F.count_if(files).alias("n_files"), F.sum(F.when(files, F.col("size")).otherwise(0)).alias("n_bytes"))


def restore_sample(items: DataFrame, archives: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` files of the newest archive with items of each repository, in archive order."""
    held = items.select("archive_name").distinct()
    newest = latest_archive(archives.join(held, "archive_name", "left_semi"))
    files = items.where(F.col("item_type") == "File").select("archive_name", "item_id", "path", "size").join(newest.select("repo_path", "archive_name"), "archive_name")
    rank = F.row_number().over(Window.partitionBy("repo_path").orderBy("item_id"))
    return files.withColumn("n", rank).where(F.col("n") <= n).select("repo_path", "archive_name", "item_id", "path", "size", "n")
