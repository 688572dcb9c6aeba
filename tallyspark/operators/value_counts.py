"""Column profiles from maintained value–count tables.

For every dataset, column and value a table holds how many rows of the newest load carry the value. A load is applied as
signed deltas (its count of a value less the maintained one), and every profile figure - null share, distinct values,
range, mean and deviation, entropy, rows that break the statement, shift against the load before - is derived by
``figures`` from maintained counts and deltas alone. ``ValueCountStore`` keeps the table between runs as versioned
Parquet on any file system that Spark reads and applies load by load; ``maintained`` replays all loads of a table in one
pass with the same algebra, which is what the queries use. Both hand the same rows to ``figures``.

Rows are counted where they are read, before anything is joined or tested: counts are combined on the map side, so a value
that a third of all rows share costs one partial row per task, and patterns are tested once per distinct value and load.
Columns are unpivoted to text; numbers are read back from it.

Defined results: a null value is counted as a value of its own (value null); repeated rows count as they lie; a column
with no non-null value has null range, mean and entropy 0; rows without dataset or load don't count; an empty table has
no profile. Only declared and named columns are read. A load that the maintained table has no predecessor of (number one
less) has no prev_* figures and no shift.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.engine.shared import durable, shared_folder

SPEC = "array<struct<name:string,physical_type:string,semantic_type:string,is_nullable:boolean,comment:string>>"
KEY = ("dataset_name", "load_no")
NUMERIC_TYPES = ("int", "bigint", "smallint", "tinyint", "float", "double")
#: Limits of the findings (fixed values of the contract).
NULL_SHARE_LIMIT, MIX_LIMIT = 0.15, 0.35


def counting_registrations(catalog: DataFrame) -> DataFrame:
    """(dataset_name, load_no, row_count, spec): of each load the registration with the latest updated_at.

    Of registrations of one time the greatest columns_json counts; rows without dataset, load or time don't.
    """
    rows = catalog.filter("dataset_name is not null and load_no is not null and updated_at is not null")
    newest = rows.groupBy(*KEY).agg(F.max(F.struct("updated_at", "columns_json", "row_count")).alias("r"))
    return newest.select(*KEY, F.col("r.row_count").alias("row_count"), F.from_json("r.columns_json", SPEC).alias("spec"))


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(dataset_name, load_no, column_name, value, n): how many rows hold each value of each column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    long = rows.filter("dataset_name is not null and load_no is not null").select(*KEY, F.inline(pairs))
    return long.groupBy(*KEY, "column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def signed_deltas(counts: DataFrame) -> DataFrame:
    """(dataset_name, column_name, value, load_no, delta): each load's change of the count of a value.

    A value of load k adds n at k and takes n away at k + 1.
    """
    steps = F.array(
        F.struct(F.col("load_no").alias("load_no"), F.col("n").alias("delta")),
        F.struct((F.col("load_no") + 1).cast("int").alias("load_no"), (-F.col("n")).alias("delta")),
    )
    moved = counts.select("dataset_name", "column_name", "value", F.inline(steps))
    return moved.groupBy("dataset_name", "column_name", "value", "load_no").agg(F.sum("delta").alias("delta"))


def maintained_history(counts: DataFrame) -> DataFrame:
    """The deltas with n, the maintained count after each load that touches a value, and before, the count before it."""
    w = Window.partitionBy("dataset_name", "column_name", "value").orderBy("load_no").rowsBetween(Window.unboundedPreceding, 0)
    return signed_deltas(counts).withColumn("n", F.sum("delta").over(w)).withColumn("before", F.col("n") - F.col("delta"))


#: Loads that are replayed side by side.
LOADS_AT_ONCE = 32


def maintained(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``maintained_history`` of all loads of the rows: (dataset_name, column_name, value, load_no, n, delta).

    One aggregate keeps a count per load beside each value, so that there is one shuffle, of map-side combined counts, and
    no sort; deltas are differences of neighbouring counts. Load numbers are replayed LOADS_AT_ONCE at a time.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    numbered = rows.filter("dataset_name is not null and load_no is not null")
    loads = sorted(r.load_no for r in numbered.select("load_no").distinct().collect())
    out = None
    for k in range(0, max(1, len(loads)), LOADS_AT_ONCE):
        own = sorted({x for n in loads[k : k + LOADS_AT_ONCE] for x in (n, n + 1)})
        known = sorted({*own, *(n - 1 for n in own)} & set(loads))
        # a load that follows this slice is emitted with the next, where its own rows are counted
        emitted = [n for n in own if n in loads[k : k + LOADS_AT_ONCE] or n not in loads]
        counted = numbered if len(known) == len(loads) else numbered.filter(F.col("load_no").isin(*known))
        long = counted.select("dataset_name", "load_no", F.inline(pairs))
        held = long.groupBy("dataset_name", "column_name", "value").agg(F.count(F.lit(1)).alias("n_all"), *[F.count_if(F.col("load_no") == n).alias(f"n{n}") for n in known])
        count = lambda n, known=known: F.col(f"`n{n}`") if n in known else F.lit(0).cast("long")
        steps = F.array(*[F.struct(F.lit(n).cast("int").alias("load_no"), count(n).alias("n"), (count(n) - count(n - 1)).alias("delta")) for n in emitted])
        touched = F.filter(steps, lambda x: (x["n"] > 0) | (x["delta"] != 0)) if emitted else F.array().cast("array<struct<load_no:int,n:bigint,delta:bigint>>")
        part = held.select("dataset_name", "column_name", "value", F.inline(touched))
        out = part if out is None else out.unionByName(part)
    return out


class ValueCountStore:
    """Persistent value–count table of one kind of rows: each applied load makes a new version of it.

    folder must be shared by all executors; it may lie on any file system that Spark knows. Versions are written to a new
    directory that a rename then numbers, so a failed run leaves the version before. A load that is already applied is
    refused.
    """

    def __init__(self, spark: SparkSession, folder: str, columns: list[str]) -> None:
        self.spark, self.folder, self.columns = spark, folder.rstrip("/"), list(columns)
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _version(self) -> str | None:
        """The newest version's directory."""
        if not self._fs.exists(self._path(self.folder)):
            return None
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.folder))]
        return max((n for n in names if n.startswith("current-")), default=None, key=lambda n: int(n.split("-")[1]))

    def current(self) -> DataFrame | None:
        """(dataset_name, column_name, value, load_no, n) of the newest load of each dataset."""
        newest = self._version()
        return None if newest is None else self.spark.read.parquet(f"{self.folder}/{newest}")

    def apply(self, rows: DataFrame) -> DataFrame:
        """Apply one load per dataset; returns its signed deltas (dataset_name, column_name, value, load_no, delta)."""
        return self.changes(rows).filter("delta <> 0").drop("n")

    def changes(self, rows: DataFrame) -> DataFrame:
        """Apply one load per dataset; returns (dataset_name, column_name, value, load_no, n, delta) of all values it or the load before holds."""
        counts = value_counts(rows, self.columns)
        loads = counts.groupBy("dataset_name").agg(F.max("load_no").alias("load_no"), F.min("load_no").alias("first"))
        if loads.filter("first <> load_no").limit(1).count():
            raise ValueError("one load of a dataset is applied at a time")
        old = self.current()
        new = counts.select("dataset_name", "column_name", "value", F.col("n").alias("n1"))
        if old is None:
            changed = new.select("dataset_name", "column_name", "value", F.col("n1").alias("delta"), F.col("n1").alias("n"))
        else:
            seen = old.groupBy("dataset_name").agg(F.max("load_no").alias("seen"))
            if loads.join(seen, "dataset_name").filter("load_no <= seen").limit(1).count():
                raise ValueError("this load is already applied")
            kept = old.join(loads.select("dataset_name"), "dataset_name", "left_semi").select("dataset_name", "column_name", "value", F.col("n").alias("n0"))
            key = [new[c].eqNullSafe(kept[c]) for c in ("dataset_name", "column_name", "value")]
            both = new.join(kept, key, "full")
            changed = both.select(
                *[F.coalesce(new[c], kept[c]).alias(c) for c in ("dataset_name", "column_name", "value")],
                (F.coalesce("n1", F.lit(0)) - F.coalesce("n0", F.lit(0))).alias("delta"), F.coalesce("n1", F.lit(0)).alias("n"),
            )
        changed = durable(changed.join(loads.select("dataset_name", "load_no"), "dataset_name"))
        state = changed.filter("n > 0").select("dataset_name", "column_name", "value", "load_no", "n")
        if old is not None:
            state = old.select(*state.columns).join(loads.select("dataset_name"), "dataset_name", "left_anti").unionByName(state)
        newest = self._version()
        number = 1 + (int(newest.split("-")[1]) if newest else 0)
        written = f"{self.folder}/new-{uuid.uuid4().hex}"
        state.write.parquet(written)
        if not self._fs.rename(self._path(written), self._path(f"{self.folder}/current-{number}")):
            raise OSError(f"version {number} can't be put in place")
        return changed.select("dataset_name", "column_name", "value", "load_no", "n", "delta")


def _bound(comment: Column, group: int) -> Column:
    text = F.regexp_extract(comment, r"^range\s+(\S+?)\.\.(\S+)$", group)
    return F.when(text != "", text)


def specifications(registered: DataFrame) -> DataFrame:
    """One row per listed column of a load: what the registration says, its pattern and its bounds as text and numbers."""
    listed = registered.select(*KEY, "row_count", F.posexplode("spec").alias("at", "s")).filter("s.name is not null")
    first = listed.groupBy(*KEY, "row_count", F.col("s.name").alias("column_name")).agg(F.min_by("s", "at").alias("s"))
    comment = F.col("s.comment")
    pattern = F.regexp_extract(comment, r"^pattern\s+(.*)$", 1)
    low, high = _bound(comment, 1), _bound(comment, 2)
    return first.select(
        *KEY, "row_count", "column_name", F.col("s.semantic_type").alias("semantic_type"), F.col("s.is_nullable").alias("is_nullable"), F.regexp_extract(comment, r"^(pattern|range)\s", 1).alias("off_rule"),
        F.when(pattern != "", F.concat(F.lit("^(?:"), pattern, F.lit(")$"))).alias("pattern"), low.alias("low_text"), high.alias("high_text"), low.try_cast("double").alias("low_number"), high.try_cast("double").alias("high_number"),
    )


#: Listed columns of all loads up to which specifications are broadcast (about 100 bytes each), and distinct patterns that are compiled once each.
BROADCAST_SPECS, COMPILED_PATTERNS = 100_000, 500


def _matches(patterns: list[str]) -> Column:
    """Whether value matches its row's pattern; known patterns are constants, so that each is compiled once."""
    out = F.regexp_like("value", "pattern")
    for p in patterns:
        out = F.when(F.col("pattern") == p, F.col("value").rlike(p)).otherwise(out)
    return out


def categories_of(specs: DataFrame, kinds: dict[str, str]) -> list[str]:
    """The columns that some load lists as categories; at most the columns of the table."""
    return sorted(r.column_name for r in specs.filter("semantic_type = 'DIMENSION_CATEGORICAL'").select("column_name").distinct().filter(F.col("column_name").isin(*kinds)).collect())


def figures(changes: DataFrame, specs: DataFrame, kinds: dict[str, str], of_categories: DataFrame | None = None) -> DataFrame:
    """All profile figures of every load and listed column, from rows (dataset_name, column_name, value, load_no, n, delta).

    kinds: the type of each column; of_categories: the changes of ``categories_of``, where they can be had more cheaply than
    from all changes. Rows of n = 0, values that a load no longer holds, count for the shift only.
    """
    numeric = [c for c, k in kinds.items() if k.startswith("decimal") or k in NUMERIC_TYPES]
    dates = [c for c, k in kinds.items() if k == "date"]
    text = [c for c in kinds if c not in numeric and c not in dates]
    at = [*KEY, "column_name"]
    known = specs
    patterns = [r.pattern for r in known.filter("pattern is not null").select("pattern").distinct().limit(COMPILED_PATTERNS + 1).collect()]
    stated = known.filter("off_rule <> ''").select(*at, "pattern", "low_text", "high_text", "low_number", "high_number")
    stated_rows, listed_rows = known.agg(F.count_if(F.col("off_rule") != ""), F.count(F.lit(1))).first()
    joined = changes.filter("n > 0").join(F.broadcast(stated) if stated_rows <= BROADCAST_SPECS else stated, at, "left")
    value, is_number = F.col("value"), F.col("column_name").isin(*numeric) if numeric else F.lit(False)
    is_date, is_text = F.col("column_name").isin(*dates) if dates else F.lit(False), F.col("column_name").isin(*text) if text else F.lit(False)
    measured = F.when(is_number, value.try_cast("double"))
    number = F.coalesce(measured, F.when(is_date, F.unix_date(value.try_cast("date")).cast("double")))
    outside = F.when(is_number, (measured < F.col("low_number")) | (measured > F.col("high_number"))).otherwise((value < F.col("low_text")) | (value > F.col("high_text")))
    unlike = F.when(F.col("pattern").isNotNull(), ~_matches(patterns if len(patterns) <= COMPILED_PATTERNS else []))
    off = value.isNotNull() & (F.coalesce(unlike, F.lit(False)) | F.coalesce(outside, F.lit(False)))
    held = F.col("n") > 0
    # conditions refer to n, so that they aren't moved below the counts, which all three aggregates share
    only = lambda c: F.coalesce(F.when(held | (F.col("delta") != 0), c), F.lit(False))
    n = F.when(value.isNotNull() & held, F.col("n"))
    # all buffers are numbers, so this stays a hash aggregate
    sums = joined.groupBy(*at).agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(value.isNull(), F.col("n"))), F.lit(0)).alias("n_null"), F.count(n).alias("n_distinct"),
        F.min(F.when(held, number)).alias("low"), F.max(F.when(held, number)).alias("high"), F.min(F.when(held & is_text, F.length("value"))).alias("min_length"), F.max(F.when(held & is_text, F.length("value"))).alias("max_length"),
        F.sum(n * measured).alias("total"), F.sum(n * measured * measured).alias("squares"), F.sum(n * F.log(n)).alias("nlogn"), F.coalesce(F.sum(F.when(off, F.col("n"))), F.lit(0)).alias("n_off"),
    ).filter("n_rows > 0").withColumn("filled", F.col("n_rows") - F.col("n_null"))
    ends = changes.filter(only(is_text & held & value.isNotNull())).groupBy(*at).agg(F.min("value").alias("first_text"), F.max("value").alias("last_text"))
    flat = F.col("low") == F.col("high")
    variance = F.try_divide(F.col("squares") - F.try_divide(F.col("total") * F.col("total"), F.col("filled")), F.col("filled"))
    shown = lambda c, t: F.when(is_number, F.col(c).cast("string")).when(is_text, F.col(t)).otherwise(F.date_from_unix_date(F.col(c).cast("int")).cast("string"))
    own = durable(sums.join(ends, at, "left").select(
        *at, "n_rows", "n_null", "filled", "n_distinct", shown("low", "first_text").alias("min_value"), shown("high", "last_text").alias("max_value"), "min_length", "max_length",
        # equal values have exactly their mean and no spread, whatever their sums round to
        F.when(is_number, F.when(flat, F.col("low")).otherwise(F.try_divide("total", "filled"))).alias("mean"),
        F.when(is_number, F.when(flat, 0.0).otherwise(F.sqrt(F.greatest(variance, F.lit(0.0))))).alias("deviation"),
        F.when(F.col("filled") > 0, F.greatest(F.log("filled") - F.col("nlogn") / F.col("filled"), F.lit(0.0))).otherwise(0.0).alias("entropy"), "n_off",
    ))
    listed = known.select(*at, "row_count", "semantic_type", "is_nullable", "off_rule")
    prev = own.select("dataset_name", (F.col("load_no") + 1).cast("int").alias("load_no"), "column_name", *[F.col(c).alias(f"prev_{c}") for c in ("n_rows", "n_null", "filled", "n_distinct", "mean", "deviation")])
    both = durable(listed.join(own, at).join(prev, at, "left"))
    shares = both.filter("semantic_type = 'DIMENSION_CATEGORICAL' and filled > 0 and prev_filled > 0").select(*at, "filled", "prev_filled")
    moved = F.abs(F.col("n") / F.col("filled") - (F.col("n") - F.col("delta")) / F.col("prev_filled"))
    moving = changes.filter(only(F.col("column_name").isin(*categories_of(known, kinds)))) if of_categories is None else of_categories
    wide = moving.filter(only(value.isNotNull())).join(F.broadcast(shares) if listed_rows <= BROADCAST_SPECS else shares, at)
    shift = wide.groupBy(*at).agg((F.sum(moved) / 2).alias("shift"))
    return both.join(shift, at, "left").select(
        *at, "semantic_type", "is_nullable", "row_count", "n_rows", "n_null", "n_distinct", "min_value", "max_value", "min_length", "max_length", "mean", "deviation", "entropy", "off_rule", "n_off", "shift",
        "filled", "prev_n_rows", "prev_n_null", "prev_filled", "prev_n_distinct", "prev_mean", "prev_deviation",
    )


def profile(rows: DataFrame, catalog: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A profile of every listed column of every load of the datasets that ``rows`` hold.

    Columns: dataset_name, load_no, column_name, semantic_type, is_nullable, row_count (declared), n_rows, n_null,
    n_distinct, min_value, max_value (text in code point order), min_length, max_length (of text), mean, deviation
    (population), entropy (nats), n_off (rows that break the comment, by rule ``off_rule``: pattern or range), shift (half
    the sum of share differences against the load before), filled, and prev_* figures of that load.
    """
    names = columns or [c for c in rows.columns if c not in (*KEY, "loaded_at")]
    kinds = {c: k for c, k in rows.dtypes if c in names}
    here = rows.select("dataset_name").distinct()
    specs = durable(specifications(counting_registrations(catalog).join(here, "dataset_name", "left_semi")))
    categories = categories_of(specs, kinds)
    return figures(maintained(rows, names), specs, kinds, maintained(rows, categories) if categories else None)


def findings(profiles: DataFrame, rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """(dataset_name, load_no, column_name, finding): where rows break the statement or differ from the load before."""
    both = (F.col("filled") > 0) & (F.col("prev_filled") > 0)
    per_hundred = round(NULL_SHARE_LIMIT * 100)
    gap = F.abs(F.col("n_null") * F.col("prev_n_rows") - F.col("prev_n_null") * F.col("n_rows")) * 100
    tests = {
        "null_in_required": ~F.col("is_nullable") & (F.col("n_null") > 0),
        "range": (F.col("off_rule") == "range") & (F.col("n_off") > 0),
        "pattern": (F.col("off_rule") == "pattern") & (F.col("n_off") > 0),
        "null_share": gap > per_hundred * F.col("n_rows") * F.col("prev_n_rows"),
        "mix": F.col("shift") > MIX_LIMIT,
        "level": (F.col("semantic_type") == "MEASURE") & both & (F.abs(F.col("mean") - F.col("prev_mean")) > F.col("prev_deviation")),
        "distinct": (F.col("semantic_type") == "IDENTIFIER") & both & (
            (2 * F.col("n_distinct") * F.col("prev_filled") < F.col("prev_n_distinct") * F.col("filled"))
            | (F.col("n_distinct") * F.col("prev_filled") > 2 * F.col("prev_n_distinct") * F.col("filled"))
        ),
    }
    named = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()]))
    at_columns = profiles.select(*KEY, "column_name", F.explode(named).alias("finding"))
    sizes = rows.filter("dataset_name is not null and load_no is not null").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_rows"))
    here = sizes.select("dataset_name").distinct()
    stated = counting_registrations(catalog).select(*KEY, "row_count").join(here, "dataset_name", "left_semi")
    wrong = stated.join(sizes, list(KEY), "left").filter(~F.col("row_count").eqNullSafe(F.coalesce("n_rows", F.lit(0))))
    return at_columns.unionByName(wrong.select(*KEY, F.lit("*").alias("column_name"), F.lit("row_count").alias("finding")))


def quality_findings(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    return findings(profile(rows, catalog), rows, catalog)


def store_folder(spark: SparkSession, name: str) -> str:
    """A folder for a ValueCountStore in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}"
