"""Run, summary and edge tables: schemas, checked readers, checked writers.

A store that grows (`put_table`, `put_runs`, `put_edges`) has a folder per condition and
representation.  Models are replaced or added one by one; the folders of other conditions
and representations keep their files, and a write that fails leaves the old state.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqstates.functions.text import representation_name
from seqstates.sources.scratch import materialize

_RUN_TYPES = {
    "series_id": T.StringType(),
    "length": T.LongType(),
    "train_frac": T.DoubleType(),
    "process": T.StringType(),
    "base_process": T.StringType(),
    "eps": T.DoubleType(),
    "flip_p": T.DoubleType(),
    "subsample_step": T.IntegerType(),
    "wrappers": T.StringType(),
    "condition_id": T.StringType(),
    "representation": T.StringType(),
    "k": T.IntegerType(),
    "reconstructor": T.StringType(),
    "logloss": T.DoubleType(),
    "n_states": T.IntegerType(),
    "C_mu_empirical": T.DoubleType(),
    "unifilarity_score": T.DoubleType(),
    "branch_entropy": T.DoubleType(),
}
RUN_SCHEMA = T.StructType([T.StructField(name, kind) for name, kind in _RUN_TYPES.items()])
RUN_COLUMNS = RUN_SCHEMA.names

SUMMARY_KEYS = [
    "base_process",
    "condition_id",
    "flip_p",
    "subsample_step",
    "reconstructor",
    "representation",
    "k",
]
METRICS = ["logloss", "n_states", "C_mu_empirical", "unifilarity_score", "branch_entropy"]
SUMMARY_SCHEMA = T.StructType(
    [RUN_SCHEMA[c] for c in SUMMARY_KEYS]
    + [T.StructField("n", T.LongType())]
    + [T.StructField(f"{m}_{s}", T.DoubleType()) for m in METRICS for s in ("mean", "std")]
)
SEED_COLUMNS = ["draw_seed", "noise_seed"]  # kept in run tables on demand
FOLDERS = ["condition_id", "representation"]
RUN_MODEL = ["series_id", "k", "length", "train_frac", "eps", "reconstructor"]
EDGE_MODEL = ["series_id", "k"]
CSV_NULL = {"nullValue": "\\N"}  # an empty text, which is written with quotes, is not NULL
PHASE_COLUMNS = ["flip_p", "subsample_step", "k", "branch_entropy_mean", "unifilarity_score_mean"]


def require_columns(df: DataFrame, required: Iterable[str], where: str = "table") -> DataFrame:
    lacking = [c for c in dict.fromkeys(required) if c not in df.columns]
    if lacking:
        raise ValueError(f"{where} has no column {', '.join(sorted(lacking))}")
    return df


def _stored(spark: SparkSession, path: str, fmt: str) -> DataFrame | None:
    """The stored table with its own column order, or None where there is none."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    try:
        return reader.format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _write(df: DataFrame, path: str, fmt: str, mode: str, partition_by: Iterable[str] = ()) -> None:
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True).options(**CSV_NULL)
    partition_by = list(partition_by)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def append_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append; the stored columns have to be the same in the same order, in typed formats with the same types."""
    stored = _stored(df.sparkSession, path, fmt)
    if stored is not None:
        old, new = (t.columns if fmt == "csv" else t.dtypes for t in (stored, df))
        if old != new:
            raise ValueError(f"{path} holds {old}, so {new} cannot be added to it")
    _write(df, path, fmt, "append")


def save_table(df: DataFrame, path: str, fmt: str = "parquet", force: bool = False) -> None:
    """Write a table; an existing one is refused, or replaced as a whole with `force`."""
    _write(df, path, fmt, "overwrite" if force else "errorifexists")


def save_edges(
    edges: DataFrame,
    path: str,
    fmt: str = "json",
    representation: str | None = None,
    noisy: bool = False,
    force: bool = False,
) -> None:
    """Edges of all models, or of one representation, in a folder per condition and k."""
    if "representation" not in edges.columns:
        edges = edges.withColumn("representation", representation_name(edges["k"], noisy))
    if representation is not None:
        edges = edges.where(edges["representation"] == representation)
    mode = "overwrite" if force else "errorifexists"
    _write(edges, path, fmt, mode, ["condition_id", "k"])


def _same(left: DataFrame, right: DataFrame, columns: Iterable[str]) -> Column:
    """Equality of key columns, in which NULL is a value."""
    same = F.lit(True)
    for c in columns:
        same = same & left[c].eqNullSafe(right[c])
    return same


def _kept_types(df: DataFrame, path: str, folders: list[str]) -> DataFrame | None:
    """The store at `path` with the columns of `df`, or None; a store of other columns or types is refused."""
    for c in folders:
        if df.schema[c].dataType != T.StringType():
            raise ValueError(f"folder column {c} has to be text")
    stored = _stored(df.sparkSession, path, "parquet")
    if stored is None:
        return None
    # The types of folder columns are guessed from names, so only the others are compared.
    old, new = (sorted(t for t in x.dtypes if t[0] not in folders) for x in (stored, df))
    if old != new or not set(folders) <= set(stored.columns):
        raise ValueError(f"{path} holds {old} in folders of {[c for c in stored.columns if c in folders]}, so {new} cannot be added to it")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_table(df: DataFrame, path: str, model: Iterable[str], folders: Iterable[str] = FOLDERS) -> None:
    """Replace the models of `df` in a Parquet store, and add those that it does not hold.

    A model is one value of folder and model columns together.  Only the folders that occur
    in `df` are written again; in them the other models are kept.  What is to be written is
    complete in the shared folder before a file of the store is touched, and Spark moves new
    files into place only when all are written.
    """
    folders, keys = list(folders), [*folders, *model]
    require_columns(df, keys, "the table to be stored")
    stored = _kept_types(df, path, folders)
    rows = materialize(df, "put")
    if stored is not None:
        touched = rows.select(*folders).distinct()
        replaced = rows.select(*keys).distinct()
        kept = stored.join(touched, _same(stored, touched, folders), "left_semi")
        kept = kept.join(replaced, _same(kept, replaced, keys), "left_anti")
        rows = rows.unionByName(materialize(kept.select(*df.columns), "kept"))
    # Partitions of an even size by folder: large folders are split, small ones share a task.
    writer = rows.hint("rebalance", *folders).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*folders).parquet(path)


def put_runs(runs: DataFrame, path: str, model: Iterable[str] = RUN_MODEL) -> None:
    """Run rows; rows of other settings of a series and k stay beside them."""
    put_table(runs, path, [*model, *(c for c in SEED_COLUMNS if c in runs.columns)])


def put_edges(edges: DataFrame, path: str, representation: str | None = None, noisy: bool = False) -> None:
    """Edges of all models, or of one representation; a model's edges are replaced together."""
    if "representation" not in edges.columns:
        edges = edges.withColumn("representation", representation_name(edges["k"], noisy))
    if representation is not None:
        edges = edges.where(edges["representation"] == representation)
    put_table(edges, path, EDGE_MODEL)


def not_stored(models: DataFrame, path: str, keys: Iterable[str]) -> DataFrame:
    """Those rows of `models` whose keys the store at `path` does not hold; all of them where there is no store."""
    keys = list(keys)
    stored = _stored(models.sparkSession, path, "parquet")
    if stored is None:
        return models
    held = models.sparkSession.read.schema(T.StructType([models.schema[c] for c in keys])).parquet(path).distinct()
    return models.join(held, _same(models, held, keys), "left_anti")


def read_stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A store of `put_table`; its folder columns come back as text, whatever their names look like."""
    return spark.read.schema(schema).parquet(path)


_BAD = "_malformed"


def _raised(line: Column) -> Column:
    return F.raise_error(F.concat(F.lit("malformed row in "), F.col("_metadata.file_path"), F.lit(": "), line))


def _typed_csv(spark: SparkSession, path: str, layout: T.StructType) -> DataFrame:
    """Typed rows; `_malformed` has the line of a row with a bad cell among those that are parsed."""
    layout = T.StructType([*layout, T.StructField(_BAD, T.StringType())])
    reader = spark.read.schema(layout).options(**CSV_NULL, emptyValue="", mode="PERMISSIVE", columnNameOfCorruptRecord=_BAD)
    return reader.csv(path, header=True, enforceSchema=False)


def _cast(column: Column, kind: T.DataType) -> Column:
    """A cast that ends the job on a text that is no such value, in every mode of the session."""
    bad = column.isNotNull() & column.try_cast(kind).isNull()
    return F.when(bad, _raised(column.cast("string")).cast(kind)).otherwise(column.try_cast(kind))


def _read(
    spark: SparkSession,
    path: str,
    fmt: str,
    schema: T.StructType,
    required: Iterable[str],
    renamed: Mapping[str, str] | None = None,
    bad: str = "raise",
) -> DataFrame:
    """Typed table from columns found by name; those the file lacks are left out."""
    stored = _stored(spark, path, fmt)
    if stored is None:
        raise FileNotFoundError(f"no table at {path}")
    renamed = {a: b for a, b in (renamed or {}).items() if a in stored.columns and b not in stored.columns}
    header, stored = stored.columns, stored.withColumnsRenamed(renamed)
    require_columns(stored, required, path)
    if bad not in ("raise", "drop", "show"):
        raise ValueError(f"unknown treatment of malformed rows: {bad}")
    if fmt != "csv":
        return stored.select(*[_cast(stored[f.name], f.dataType).alias(f.name) for f in schema if f.name in stored.columns])
    # Positions come from the file's own header, so order and extra columns are free.
    types = {f.name: f.dataType for f in schema}
    layout = T.StructType([T.StructField(c, types.get(renamed.get(c, c), T.StringType())) for c in header])
    typed = _typed_csv(spark, path, layout).withColumnsRenamed(renamed)
    # Only cells that are asked for are parsed, so the condition names all of them.
    cells = F.concat_ws("", *[F.col(f"`{c}`").cast("string") for c in typed.columns if c != _BAD])
    if bad == "show":
        return typed.where(F.col(_BAD).isNotNull() & (F.length(cells) >= 0)).select(F.col("_metadata.file_path").alias("file"), F.col(_BAD).alias("line"))
    refused = F.length(cells) < 0 if bad == "drop" else _raised(F.concat(F.col(_BAD), F.substring(cells, 1, 0))).cast("boolean")
    whole = F.when(F.col(_BAD).isNull(), F.lit(True)).otherwise(refused)
    return typed.where(whole).select(*[c for c in schema.names if c in typed.columns])


def read_runs(spark: SparkSession, path: str, fmt: str = "csv", bad: str = "raise") -> DataFrame:
    """Run rows; a `seed` column serves as the series where there is none of its own.

    A row with a cell that is no value of its column's type, or with too few or too many
    cells, ends the job and is named; with `bad="drop"` such rows are left out instead.
    """
    return _read(spark, path, fmt, RUN_SCHEMA, {*SUMMARY_KEYS, "series_id", *METRICS}, {"seed": "series_id"}, bad)


def read_summary(spark: SparkSession, path: str, fmt: str = "csv", bad: str = "raise") -> DataFrame:
    return _read(spark, path, fmt, SUMMARY_SCHEMA, PHASE_COLUMNS, None, bad)


def malformed_runs(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of the rows of a CSV run table that `read_runs` refuses."""
    return _read(spark, path, "csv", RUN_SCHEMA, {*SUMMARY_KEYS, "series_id", *METRICS}, {"seed": "series_id"}, "show")
