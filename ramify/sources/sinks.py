"""Artifacts with provenance: tables and sidecars, freshness, hashes, commented delimited files, workbooks, reports."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
import zipfile
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import assert_schema, at_most, EngineError
from ..operators.hierarchy import closure


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def cache_key(**parts: object) -> str:
    """A file stem of all parameters that a result depends on, in order of their names; long ones end in a hash."""
    text = "__".join(f"{k}-{json.dumps(v, sort_keys=True, default=str) if not isinstance(v, str) else v}" for k, v in sorted(parts.items()))
    stem = re.sub(r"[^A-Za-z0-9._-]+", "_", text)
    return stem if len(stem) <= 120 and stem == text else f"{stem[:100]}__{hashlib.sha256(text.encode()).hexdigest()[:16]}"


# ---------------------------------------------------------------- Hadoop paths: what Spark reads, these write


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside and renamed."""
    fs, p = _fs(spark, path)
    tmp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    fs.rename(tmp, p)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    return "\n".join(r["value"] for r in spark.read.text(path).collect())


# ---------------------------------------------------------------- hashes


def table_hash(df: DataFrame) -> str:
    """A hash of a table's rows that doesn't depend on their order or partitions; any size."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in df.columns]
    row = F.xxhash64(*cols), F.xxhash64(F.lit(1), *cols)
    r = df.select(row[0].alias("a"), row[1].alias("b")).agg(F.count("*"), *(F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(0)) for c in ("a", "b")), F.bit_xor("a")).first()
    return hashlib.sha256(json.dumps([df.columns, *map(str, r)]).encode()).hexdigest()


def row_block(rows: Sequence[Mapping[str, object]], columns: Sequence[str] | None = None) -> str:
    """The canonical text of a small table: comma form with a header, nulls empty."""
    columns = list(columns or (rows[0].keys() if rows else []))
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(columns)
    w.writerows([["" if r.get(c) is None else r[c] for c in columns] for r in rows])
    return out.getvalue()


#: Rows of a table that is written or hashed as one piece; larger ones are artifacts of many files.
SMALL = 1_000_000


def row_block_hash(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row: sha256 of a small table's canonical lines, in the given order; values are plain strings (no quoting)."""
    df = at_most(df, SMALL, "row_block_hash")
    line = F.array_join(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)), ",")
    lines = F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"])
    return df.agg(F.sha2(F.concat(F.lit(",".join(df.columns) + "\n"), F.array_join(lines, "\n"), F.lit("\n")), 256).alias("sha256"))


# ---------------------------------------------------------------- artifacts


def write_artifact(df: DataFrame, path: str, columns: Sequence[str], *, params: Mapping[str, object] | None = None, require_non_empty: bool = True, single_file: bool = False, **meta: object) -> dict:
    """df as a folder of TSV files and a sidecar `path`.meta.json with its content hash; nulls are empty.

    The commit protocol publishes the folder. single_file is for small tables. Returns the sidecar.
    """
    out = assert_schema(df, columns, "write_artifact").select(*columns, *(c for c in df.columns if c not in columns))
    out = out.select(*(F.array_join(c, ";").alias(c) if isinstance(out.schema[c].dataType, T.ArrayType) else F.col(c) for c in out.columns))
    (out.coalesce(1) if single_file else out).write.mode("overwrite").option("emptyValue", "").csv(path, sep="\t", header=True, nullValue="")
    back = df.sparkSession.read.csv(path, sep="\t", header=True, schema=", ".join(f"`{c}` string" for c in out.columns))
    if require_non_empty and back.isEmpty():
        raise EngineError("write_artifact", f"no rows for {path}")
    side = {"artifact": path, "sha256": table_hash(back), "stamped_at": now(), "fetched_at": now(), "params": {k: str(v) for k, v in (params or {}).items()}, **meta}
    write_text(df.sparkSession, path + ".meta.json", json.dumps(side, sort_keys=True, indent=2, default=str))
    return side


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True)


def read_sidecar(spark: SparkSession, path: str) -> dict | None:
    """The sidecar of an artifact under either convention (x.tsv.meta.json or x.meta.json); both hash keys are read."""
    for name in (path + ".meta.json", re.sub(r"\.[^./]+$", "", path) + ".meta.json"):
        text = read_text(spark, name)
        if text:
            try:
                side = json.loads(text)
            except ValueError:
                return None
            side.setdefault("sha256", side.get("output_sha256"))
            return side
    return None


def is_fresh(spark: SparkSession, path: str) -> bool:
    """The artifact and its sidecar are there, and the content has the stamped hash."""
    side = read_sidecar(spark, path)
    fs, p = _fs(spark, path)
    return bool(side) and fs.exists(p) and table_hash(read_artifact(spark, path)) == side["sha256"]


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of files (of up to 2 GB each)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"))


def stamp(spark: SparkSession, path: str, *, inputs: Sequence[str] = (), params: Mapping[str, object] | None = None, source_url: str | None = None, doi: str | None = None, data_version: str | None = None, fetched_at: str | None = None) -> dict:
    """A sidecar for any file, with the hashes of its inputs."""
    one = lambda p: file_hashes(spark, p).first()["sha256"]
    side = {"artifact": path, "sha256": one(path), "stamped_at": now(), "fetched_at": fetched_at or now(), "inputs": {p: one(p) for p in inputs}, "params": {k: str(v) for k, v in (params or {}).items()}, "source_url": source_url, "doi": doi, "data_version": data_version}
    write_text(spark, path + ".meta.json", json.dumps(side, sort_keys=True, indent=2))
    return side


def verify(spark: SparkSession, path: str) -> DataFrame:
    """path, expected, actual, ok for a stamped file and its inputs."""
    side = read_sidecar(spark, path)
    if side is None:
        raise EngineError("verify", f"no sidecar for {path}")
    want = {path: side["sha256"], **side.get("inputs", {})}
    rows = []
    for p, expected in want.items():
        fs, q = _fs(spark, p)
        actual = file_hashes(spark, p).first()["sha256"] if fs.exists(q) else None
        rows.append((p, expected, actual, actual == expected))
    return spark.createDataFrame(rows, "path string, expected string, actual string, ok boolean")


def show(spark: SparkSession, path: str) -> str:
    return json.dumps(read_sidecar(spark, path) or {}, sort_keys=True, indent=2)


def provenance_tree(edges: DataFrame) -> DataFrame:
    """All (artifact, source) pairs, direct and indirect, from edges (artifact, member)."""
    return closure(edges, child="artifact", parent="member").select(F.col("term").alias("artifact"), F.col("ancestor").alias("source"))


# ---------------------------------------------------------------- small tables for people


def provenance_lines(meta: Mapping[str, object], digest: str) -> list[str]:
    given = {k: v for k, v in meta.items() if v not in (None, "")}
    return [f"# {k}: {v}" for k, v in {**given, "sha256": digest, "stamped_at": meta.get("stamped_at") or now()}.items()]


def write_commented(df: DataFrame, path: str, meta: Mapping[str, object], *, sep: str = ",", order: Sequence[str] = ()) -> str:
    """A small table as one delimited file below # lines of provenance. The hash is of the comma form, whatever the separator."""
    df = at_most(df, SMALL, "write_commented")
    rows = [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]
    block = row_block(rows, df.columns)
    digest = hashlib.sha256(block.encode()).hexdigest()
    out = io.StringIO()
    w = csv.writer(out, delimiter=sep, lineterminator="\n")
    w.writerow(df.columns)
    w.writerows([["" if r[c] is None else r[c] for c in df.columns] for r in rows])
    write_text(df.sparkSession, path, "\n".join(provenance_lines(meta, digest)) + "\n" + out.getvalue())
    return digest


def workbook(sheets: Mapping[str, Sequence[Mapping[str, object]]], meta: Mapping[str, object]) -> bytes:
    """An xlsx of small tables with a Provenance sheet, of inline strings and numbers: the least that readers accept."""
    all_sheets = {**sheets, "Provenance": [{"key": k, "value": v} for k, v in {**meta, **{f"sha256 {n}": hashlib.sha256(row_block(r).encode()).hexdigest() for n, r in sheets.items()}}.items()]}

    def letter(n: int) -> str:
        out = ""
        while n:
            n, r = divmod(n - 1, 26)
            out = chr(65 + r) + out
        return out

    def cell(ref: str, v: object) -> str:
        if v is None:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{ref}"><v>{v}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    head, main = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel, ct = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(all_sheets) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{ct}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{ct}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(all_sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{ct}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(all_sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(all_sheets.values(), 1):
            cols = list(rows[0].keys()) if rows else []
            lines = [{c: c for c in cols}, *rows]
            body = "".join(f'<row r="{j}">' + "".join(cell(f"{letter(k)}{j}", r.get(c)) for k, c in enumerate(cols, 1)) + "</row>" for j, r in enumerate(lines, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return buf.getvalue()


def write_report(report: DataFrame, path: str) -> dict:
    """A citation report as an artifact; the sidecar has the number of rows of each status."""
    counts = {r["status"]: r["count"] for r in report.groupBy("status").count().collect()}
    return write_artifact(report, path, report.columns, require_non_empty=False, single_file=True, status_counts=counts)
