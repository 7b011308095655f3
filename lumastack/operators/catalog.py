"""Capture catalogs: file names to metadata, canonical names, grouping by filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumastack.operators.windows import ranked

# The three file-name conventions (full name; stem; stem) and the planets' abbreviations.
CANONICAL = r"^(\d{4}-\d{2}-\d{2})-(\d{4}_\d)-[^-]+-([A-Za-z0-9]+)-([A-Za-z]+)_"
TARGET_FIRST = r"^([A-Za-z][A-Za-z0-9]*)_(\d{4})(\d{2})(\d{2})-(\d{2})(\d{2})(\d{2})"
TIME_FIRST = r"^(\d{2})_(\d{2})_(\d{2})(?:[_.]|$)"
FOLDER_DATE = r"^\d{4}-\d{2}-\d{2}$"
PLANETS = {"jupiter": "Jup", "saturn": "Sat", "mars": "Mar", "uranus": "Ura", "neptune": "Nep", "venus": "Ven", "moon": "Moo", "sun": "Sun"}


def abbreviation(name: Column) -> Column:
    """A planet's abbreviation, or null."""
    table = F.create_map(*[F.lit(x) for pair in PLANETS.items() for x in pair])
    return F.try_element_at(table, F.lower(name))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _groups(text: Column, pattern: str, n: int) -> Column:
    """The first n groups of a pattern as an array; null if it does not match."""
    marked = F.regexp_replace(text, pattern + r"[\s\S]*$", "\n".join(f"${i}" for i in range(1, n + 1)))
    return F.when(text.rlike(pattern), F.split(marked, "\n"))


def _parts(path: Column) -> Column:
    """STRUCT(name, stem, parent, above) of a path."""
    return _let(F.split(path, "/"), lambda p: F.struct(F.element_at(p, -1).alias("name"), F.regexp_replace(F.element_at(p, -1), r"(?<=.)\.[^.]*$", "").alias("stem"), F.try_element_at(p, F.lit(-2)).alias("parent"), F.try_element_at(p, F.lit(-3)).alias("above")))


def _at(date: Column, hours: Column, minutes: Column, tenths: Column) -> Column:
    day = F.try_to_timestamp(date, F.lit("yyyy-MM-dd")).cast("timestamp_ntz")
    return day + F.make_dt_interval(F.lit(0), hours.cast("int"), minutes.cast("int"), (tenths * 6).cast("decimal(18,6)"))


def _clocked(groups: Column, first: int) -> Column:
    """Whether hours, minutes and seconds, three groups from `first` on, are a time of day."""
    return F.coalesce((groups[first].cast("int") <= 23) & (groups[first + 1].cast("int") <= 59) & (groups[first + 2].cast("int") <= 59), F.lit(False))


def _tenths(seconds: Column) -> Column:
    """Seconds as tenths of a minute, half to even, 9 at most."""
    return F.least(F.lit(9), F.bround(seconds.cast("int") / F.lit(6.0), 0).cast("int"))


def _folder_date(p: Column, modified: Column | None) -> Column:
    found = [F.when(f.rlike(FOLDER_DATE), f) for f in (p["parent"], p["above"])]
    return F.coalesce(*found, *([F.date_format(modified, "yyyy-MM-dd")] if modified is not None else []))


def _folder_target(p: Column) -> Column:
    return F.coalesce(abbreviation(p["parent"]), abbreviation(p["above"]))


def folder_date(path: Column, modified: Column | None = None) -> Column:
    """The date that one of the two nearest folders is named after, else the day of `modified`."""
    return _let(_parts(path), lambda p: _folder_date(p, modified))


def folder_target(path: Column) -> Column:
    """The abbreviation of the planet that one of the two nearest folders is named after, or null."""
    return _let(_parts(path), _folder_target)


def _matched(path: Column) -> Column:
    """The parts of a path with the groups of the three conventions."""
    return _let(_parts(path), lambda p: F.struct(p.alias("p"), _groups(p["name"], CANONICAL, 4).alias("a"), _groups(p["stem"], TARGET_FIRST, 7).alias("b"), _groups(p["stem"], TIME_FIRST, 3).alias("c")))


def parse_capture_name(path: Column, modified: Column | None = None) -> Column:
    """STRUCT(date, ts, filter, target, stem) from a file's path by the first convention that fits; null if none does.

    Only the first convention carries a filter; it is matched on the full name and its time is not range-checked. Seconds
    become tenths of a minute. All times are UTC.
    """

    def meta(date: Column, ts: Column, name: Column | None, target: Column, stem: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(date.alias("date"), ts.alias("ts"), (none if name is None else name).alias("filter"), target.alias("target"), stem.alias("stem"))

    def body(m: Column) -> Column:
        p, a, b, c = m["p"], m["a"], m["b"], m["c"]
        day = F.concat_ws("-", b[1], b[2], b[3])
        first = meta(a[0], _at(a[0], F.substring(a[1], 1, 2), F.substring(a[1], 3, 2), F.substring(a[1], 6, 1).cast("int")), a[2], a[3], p["stem"])
        second = meta(day, _at(day, b[4], b[5], _tenths(b[6])), None, F.coalesce(abbreviation(b[0]), F.initcap(F.substring(b[0], 1, 3))), p["stem"])
        third = _let(_folder_date(p, modified), lambda d: meta(d, _at(d, c[0], c[1], _tenths(c[2])), None, _folder_target(p), p["stem"]))
        return F.when(a.isNotNull(), first).when(_clocked(b, 4), second).when(_clocked(c, 0), third)

    return _let(_matched(path), body)


def canonical_stem(path: Column, filter_name: Column, target: Column, camera: str = "U", modified: Column | None = None) -> Column:
    """The stem rewritten to date-HHMM_D-camera-filter-target for the second and third convention; other stems unchanged."""

    def new(date: Column, h: Column, m: Column, s: Column) -> Column:
        return F.format_string("%s-%s%s_%d-%s-%s-%s", date, h, m, _tenths(s), F.lit(camera), filter_name, target)

    def body(m: Column) -> Column:
        p, b, c = m["p"], m["b"], m["c"]
        second = new(F.concat_ws("-", b[1], b[2], b[3]), b[4], b[5], b[6])
        return F.when(m["a"].isNotNull(), p["stem"]).when(_clocked(b, 4), second).when(_clocked(c, 0), new(_folder_date(p, modified), c[0], c[1], c[2])).otherwise(p["stem"])

    return _let(_matched(path), body)


def capture_catalog(paths: DataFrame, target: str | None = None, path_col: str = "path", modified_col: str | None = None) -> DataFrame:
    """(path, date, ts, filter, target, stem) of every file whose name parses; filter null becomes `color`. With a target, files of other targets are left out."""
    modified = F.col(modified_col) if modified_col else None
    meta = paths.select(F.col(path_col).alias("path"), parse_capture_name(F.col(path_col), modified).alias("m")).where("m IS NOT NULL")
    out = meta.select("path", "m.date", "m.ts", F.coalesce("m.filter", F.lit("color")).alias("filter"), "m.target", "m.stem")
    return out.where(F.col("target").isNull() | (F.col("target") == target)) if target else out


def series_catalog(paths: DataFrame, filters: list[str], path_col: str = "path") -> DataFrame:
    """The catalog for a series: `color` captures and those in one of the filters, whatever their target."""
    return capture_catalog(paths, path_col=path_col).where(F.col("filter").isin("color", *filters))


def filter_from_name(stem: Column) -> Column:
    """The filter of a video by its name: the first of IR, R, G, B, CH4 between dashes or underscores, else L."""
    found = F.lit("L")
    for f in reversed(("IR", "R", "G", "B", "CH4")):
        found = F.when(stem.contains(f"-{f}-") | stem.contains(f"_{f}_"), f).otherwise(found)
    return found


#: The order in which filters serve as reference.
REFERENCE_ORDER = ("IR", "R", "G", "B", "CH4", "color")


def pick_reference_file(files: DataFrame, filter_col: str = "filter", name_col: str = "name", forced: str | None = None) -> DataFrame:
    """The middle file by name of the filter that comes first in REFERENCE_ORDER; with `forced`, of the files whose names hold it in
    any case (of all, if none does). Files of other filters count only where no filter of the order is there."""
    if forced:
        place = F.when(F.upper(name_col).contains(forced.upper()), 0).otherwise(1)
        held = files.withColumn("_p", place)
        any_ = held.agg(F.min("_p").alias("_least"))  # one row
        held = held.join(F.broadcast(any_)).where((F.col("_p") == 0) | (F.col("_least") == 1)).withColumn("_p", F.lit(0)).drop("_least")
    else:
        order = F.array_position(F.array(*[F.lit(f) for f in REFERENCE_ORDER]), F.col(filter_col))
        held = files.withColumn("_p", F.when(order > 0, order).otherwise(99))
    best = held.groupBy("_p").agg(F.count("*").alias("_n")).orderBy("_p").limit(1).withColumnRenamed("_p", "_q")
    first = ranked(held.join(F.broadcast(best), F.col("_p") == F.col("_q")), "_p", name_col, name="_row")  # best is one row
    return first.where("_row = _n DIV 2 + 1").drop("_p", "_q", "_n", "_row")


def preflight_counts(captures: DataFrame, window_frames: int, windows: int, filter_col: str = "filter") -> DataFrame:
    """Captures of each filter and whether there are enough for the windows asked."""
    return captures.groupBy(filter_col).agg(F.count("*").alias("n")).withColumn("feasible", F.col("n") >= window_frames * windows)


def rank_sink(scores: DataFrame, path: str) -> None:
    """A folder of CSV for each filter; its files, taken by name, are in order of rank. A large filter has several files, written by as many tasks."""
    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scores.repartitionByRange(parts, "filter", "rank").sortWithinPartitions("filter", "rank").write.partitionBy("filter").csv(path, header=True)


def reload(spark, path: str) -> DataFrame:
    """Step outputs read again, partition folders (window, filter) as columns."""
    return spark.read.parquet(path)
