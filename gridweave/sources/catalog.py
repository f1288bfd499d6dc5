"""Artifacts: files with sidecars, their catalog, search, export and import; sinks that write them."""

from __future__ import annotations

import dataclasses
import getpass
import hashlib
import json
import os
import pickle
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.schema import FILE_REF, lossless, record
from gridweave.sources.artifacts import dumped, loaded, read_bytes, use_artifacts
from gridweave.sources.events import run_context

SIDECAR = record(
    "stage string, field string, row_key string, sha256 string, bytes long, written boolean, existed boolean, created_at string, creator string, code_version string, schema_signature string, params_hash string, params map<string,string>, upstream_run_id string, run_key string, run_status string, stage_fingerprint string"
)


@dataclass(frozen=True)
class Format:
    """How values are written to and read from a file."""

    writer: Callable[[Any, str], None]
    reader: Callable[[str], Any]
    extension: str


def _write_json(value: Any, path: str, **options: Any) -> None:
    with open(path, "w") as f:
        json.dump(value, f, **({"default": str} | options))


def _read_json(path: str) -> Any:
    with open(path) as f:
        return json.load(f)


def _write_pickle(value: Any, path: str, **options: Any) -> None:
    with open(path, "wb") as f:
        pickle.dump(value, f, **options)


def _read_pickle(path: str) -> Any:
    with open(path, "rb") as f:
        return pickle.load(f)


def _write_frame(kind: str) -> Callable[..., None]:
    def write(value: Any, path: str, **options: Any) -> None:
        import pandas as pd

        frame = value if isinstance(value, pd.DataFrame) else pd.DataFrame(value if isinstance(value, list) else [value])
        text = {"index": False} | ({"sep": "\t"} if kind == "tsv" else {})
        make, first = {"csv": (frame.to_csv, text), "tsv": (frame.to_csv, text), "parquet": (frame.to_parquet, {}), "feather": (frame.to_feather, {})}[kind]
        make(path, **(first | options))

    return write


def _read_frame(kind: str) -> Callable[[str], Any]:
    def read(path: str) -> Any:
        import pandas as pd

        return {"csv": pd.read_csv, "tsv": lambda p: pd.read_csv(p, sep="\t"), "parquet": pd.read_parquet, "feather": pd.read_feather}[kind](path)

    return read


_formats: dict[str, Format] = {"json": Format(_write_json, _read_json, ".json"), "rds": Format(_write_pickle, _read_pickle, ".pkl")} | {k: Format(_write_frame(k), _read_frame(k), f".{k}") for k in ("csv", "tsv", "parquet", "feather")}


def register_format(name: str, writer: Callable, reader: Callable, extension: str | None = None) -> None:
    _formats[name] = Format(writer, reader, extension or f".{name}")


def get_format(name: str) -> Format | None:
    return _formats.get(name)


def list_formats() -> list[str]:
    return sorted(_formats)


@dataclass(frozen=True)
class Sink:
    """Fields of a stage that become files below ``base`` (a folder that all executors share) and file references.

    ``overwrite``: skip (an existing file stays), overwrite or error (a file with other contents is an error). ``formats``
    names the format of single fields, or is one itself; ``options`` go to the writers. With ``autoload`` later stages
    get the values in place of references, and so does the result where the field is declared as another type than a
    reference. Sidecars have every field of SIDECAR; the status in them is that of the run while its stage writes.

    :meth:`Flow.collect` writes files while its rows are evaluated, each beside its place and then renamed; paths follow from
    the row alone, so a task that runs twice does no harm. :func:`gridweave.operators.runs.run` writes them once, when all
    rows of the stage are done, through the format ``artifacts``.
    """

    fields: tuple[str, ...]
    base: str
    template: str = "{stage}/{field}/{row_key}"
    format: str | Format = "rds"
    overwrite: str = "skip"
    sidecar: bool = True
    code_version: str | None = None
    schema_signature: str | None = None
    stage_fingerprint: str | None = None
    formats: dict[str, str | Format] = dataclasses.field(default_factory=dict)
    options: dict[str, Any] = dataclasses.field(default_factory=dict)
    autoload: bool = False

    def __post_init__(self) -> None:
        if unknown := set(self.formats) - set(self.fields):
            raise ValueError(f"no fields of the sink: {', '.join(sorted(unknown))}")
        object.__setattr__(self, "base", self.base.removeprefix("file://"))
        # Looked up here, as workers know the formats that come with the library only.
        own = {f: self.formats.get(f, self.format) for f in self.fields}
        object.__setattr__(self, "_known", {f: v if isinstance(v, Format) else _formats[v] for f, v in own.items()})

    def format_of(self, field: str) -> Format:
        return self._known[field]

    def path(self, stage: str, field: str, row: dict[str, Any]) -> str:
        key = hashlib.sha1(json.dumps({k: v for k, v in row.items() if not k.startswith(".")}, sort_keys=True, default=str).encode()).hexdigest()
        rest = self.template.format(**{**row, "stage": stage, "field": field, "row_key": key})
        if os.path.isabs(rest) or ".." in rest.split("/"):
            raise ValueError(f"{rest} leaves the sink's folder")
        end = self.format_of(field).extension
        return os.path.join(self.base, rest if rest.endswith(end) else rest + end)

    def written(self, stage: str, outputs: dict[str, Any], row: dict[str, Any]) -> dict[str, Any]:
        """The outputs with references instead of the sink's fields."""
        return outputs | {f: self._one(stage, f, outputs[f], row) for f in self.fields if f in outputs}

    def _one(self, stage: str, field: str, value: Any, row: dict[str, Any]) -> dict[str, Any]:
        path = self.path(stage, field, row)
        existed = os.path.exists(path)
        write = not existed or self.overwrite == "overwrite"
        if existed and self.overwrite == "error":
            with open(path, "rb") as f:
                if f.read() != dumped(self.format_of(field).writer, value, self.options):
                    raise FileExistsError(path)
        if write:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            beside = f"{path}.{uuid.uuid4().hex}.tmp"
            self.format_of(field).writer(value, beside, **self.options)
            os.replace(beside, path)
        with open(path, "rb") as f:
            digest = hashlib.file_digest(f, "sha256").hexdigest()
        ref = {"path": path, "bytes": os.path.getsize(path), "sha256": digest, "written": write, "existed": existed}
        if self.sidecar and write:
            _write_json(self.told(stage, field, path, row) | {k: ref[k] for k in ("sha256", "bytes", "written", "existed")}, f"{path}.side")
            os.replace(f"{path}.side", f"{path}.json")
        return ref

    def told(self, stage: str, field: str, path: str, row: dict[str, Any]) -> dict[str, Any]:
        """What a sidecar tells but for the file itself."""
        params = {k: str(v) for k, v in row.items() if not k.startswith(".") and "." not in k}
        known = run_context() or {}
        return {
            "stage": stage, "field": field, "row_key": os.path.basename(path).split(".")[0], "params": params, "params_hash": hashlib.sha1(json.dumps(params, sort_keys=True).encode()).hexdigest(),
            "created_at": datetime.now(UTC).isoformat(), "creator": getpass.getuser(), "code_version": self.code_version, "schema_signature": self.schema_signature, "stage_fingerprint": self.stage_fingerprint,
            "upstream_run_id": known.get("run_id"), "run_key": hashlib.sha1(f"{known.get('run_id')}/{stage}/{self.stage_fingerprint}".encode()).hexdigest(), "run_status": "running",
        }

    def value_of(self, field: str, ref: Any) -> Any:
        """The value of a field's file reference; anything else stays as it is."""
        if not isinstance(ref, dict) or ref.get("path") is None:
            return ref
        return loaded(self.format_of(field).reader, read_bytes(ref["path"]))


#: A field on its way to a file: what :meth:`Packing.written` makes of it.
def packed_type(kind: T.DataType) -> T.StructType:
    parts = {"path": T.StringType(), "content": T.BinaryType(), "sha256": T.StringType(), "sidecar": T.StringType(), "value": kind}
    return T.StructType([T.StructField(k, v) for k, v in parts.items()])


@dataclass(frozen=True)
class Packing(Sink):
    """A sink that packs its fields' files into the row instead of writing them. ``kinds``: the types of values that the
    result has beside their files."""

    kinds: dict[str, T.DataType] = dataclasses.field(default_factory=dict)

    def _one(self, stage: str, field: str, value: Any, row: dict[str, Any]) -> dict[str, Any]:
        path, content = self.path(stage, field, row), dumped(self.format_of(field).writer, value, self.options)
        digest = hashlib.sha256(content).hexdigest()
        side = self.told(stage, field, path, row) | {"sha256": digest, "bytes": len(content), "written": True, "existed": False}
        own = lossless(value, self.kinds[field]) if field in self.kinds else None
        return {"path": path, "content": content, "sha256": digest, "sidecar": json.dumps(side, default=str) if self.sidecar else None, "value": own}


def temporary_sink(fields: tuple[str, ...], base: str, prefix: str = "quick", **options: Any) -> Sink:
    """A sink in a new folder of its own below ``base``, which all executors share."""
    return Sink(fields, os.path.join(base, f"{prefix}-{datetime.now(UTC):%Y%m%d_%H%M%S}-{uuid.uuid4().hex[:8]}"), **options)


def is_file_ref(kind: T.DataType) -> bool:
    """Whether a column of this type holds file references."""
    return isinstance(kind, T.StructType) and {f.name: f.dataType for f in FILE_REF}.items() <= {f.name: f.dataType for f in kind}.items()


def file_ref_of(path: Column, size: Column, reused: bool = False) -> Column:
    """A reference to a file that is there: written just now, or reused."""
    values = {"path": path, "bytes": size.cast("long"), "sha256": F.lit(None).cast("string"), "written": F.lit(not reused), "existed": F.lit(reused)}
    return F.struct(*[v.alias(k) for k, v in values.items()])


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """All JSON files below a folder under one another, with the union of their fields; files that are no JSON are left
    out. The fields are inferred, so the files are read twice."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("mode", "DROPMALFORMED").json(folder, multiLine=True)
    return rows


def manifest_clear(spark: SparkSession, folder: str, stage: str | None = None) -> bool:
    """Deletes the manifest of one stage (a file or folder of its name) or all there are; whether there was one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder if stage is None else f"{folder}/{stage}.jsonl")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(ref: dict[str, Any], format: str) -> Any:
    """The value of a file reference."""
    return loaded(_formats[format].reader, read_bytes(ref["path"]))


def list_files(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """path, bytes and mtime of all files below a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"))
    return files if pattern is None else files.where(F.col("path").rlike(pattern))


def glob(spark: SparkSession, pattern: str) -> DataFrame:
    """The paths that a file pattern matches, in order; none is an empty table."""
    try:
        return spark.read.format("binaryFile").load(pattern).select("path").orderBy("path")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string")


def with_sidecars(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Files (path, any other columns) with ``_s``: their sidecars (path of the file, value as JSON) in SIDECAR's fields."""
    return files.join(sidecars.select("path", F.from_json("value", SIDECAR).alias("_s")), "path", "left")


def artifact_catalog(spark: SparkSession, folder: str, pattern: str | None = None, limit: int | None = None, without_sidecar: bool = False) -> DataFrame:
    """A row for each artifact with its sidecar's fields, in the order of paths, then limited. Sidecars without an
    artifact are left out; artifacts without one come in on request, with what their paths tell."""
    files = list_files(spark, folder)
    sides = files.where(F.col("path").endswith(".json")).select(F.regexp_replace("path", r"\.json$", "").alias("path"))
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.regexp_replace("_metadata.file_path", r"\.json$", "").alias("_p"), "value")
    plain = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    base = files.join(sides, "path", "left_semi").select(plain("path").alias("path"), F.col("bytes").alias("_bytes"), "mtime")
    rows = with_sidecars(base, text.select(plain("_p").alias("path"), "value")).select("path", F.coalesce("_s.bytes", "_bytes").alias("bytes"), "mtime", *[F.col(f"_s.{f.name}").alias(f.name) for f in SIDECAR if f.name != "bytes"])
    if without_sidecar:
        bare = files.where(~F.col("path").endswith(".json")).join(sides, "path", "left_anti").select(plain("path").alias("path"), "bytes", "mtime")
        rows = rows.unionByName(inferred(bare), allowMissingColumns=True)
    rows = rows if pattern is None else rows.where(F.col("path").rlike(pattern))
    rows = rows.orderBy("path")
    return rows if limit is None else rows.limit(limit)


def inferred(files: DataFrame) -> DataFrame:
    """Stage, field and key from the last three parts of a path, where the key is a hash."""
    parts = F.split("path", "/")
    key = F.regexp_extract(F.element_at(parts, -1), r"^([0-9a-f]{40})(\.|$)", 1)
    known = key != ""
    return files.withColumns({"stage": F.when(known, F.try_element_at(parts, F.lit(-3))), "field": F.when(known, F.try_element_at(parts, F.lit(-2))), "row_key": F.nullif(key, F.lit(""))})


def catalog_search(catalog: DataFrame, query: str | None = None, fields: tuple[str, ...] = ("path", "stage", "field", "row_key"), ignore_case: bool = True, run_status: list[str] | None = None, params: dict[str, Any] | None = None) -> DataFrame:
    """Artifacts that meet all that is given: a pattern in any of the fields, a status, parameters' values."""
    if run_status is not None:
        catalog = catalog.where(F.col("run_status").isin(*run_status))
    for k, v in (params or {}).items():
        catalog = catalog.where(F.try_element_at("params", F.lit(k)) == str(v))
    if query:
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.coalesce(F.col(f).cast("string"), F.lit("")).rlike(("(?i)" if ignore_case else "") + query)
        catalog = catalog.where(hit)
    return catalog


def export_manifest(catalog: DataFrame, path: str, run_id: str | None = None) -> None:
    """The catalog (of one run) as JSON lines in the order of paths, in a folder."""
    rows = catalog if run_id is None else catalog.where(F.col("upstream_run_id") == run_id)
    rows.orderBy("path", "stage", "field", "row_key").write.mode("overwrite").json(path)


def import_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([T.StructField("path", T.StringType()), T.StructField("mtime", T.TimestampType()), *SIDECAR])).json(path)


def verified(refs: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """File references (path, sha256) with ``intact``: whether the file is there and has the digest. Files are digested
    piece by piece, so none is held whole."""
    use_artifacts(spark)
    files = spark.read.format("artifacts").option("content", "false").load(folder).select("path", F.col("sha256").alias("_now"))
    return refs.join(files, "path", "left").withColumn("intact", F.coalesce(F.col("_now") == F.col("sha256"), F.lit(False))).drop("_now")
