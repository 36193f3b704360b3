"""Writers and readers of edge tables: Parquet, CSV, GraphML, labels, ground truth, metrics text.

Rows are rendered by expressions in parallel; only formats that are one document by definition end in one file.
"""

from __future__ import annotations

import glob
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIXED = ["src", "dst", "t", "event_type", "label", "anomaly_id"]
#: What unreadable numbers of a CSV become.
BAD_ID, BAD_TIME = -1, -(1 << 63)


def number_text(v: Column) -> Column:
    """Whole numbers without decimals, others with up to four; null and NaN empty."""
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    rounded = F.regexp_replace(F.format_string("%.4f", v), r"\.?0+$", "")
    return F.when(v.isNull() | F.isnan(v), "").when(whole, F.floor(v).cast("bigint").cast("string")).otherwise(rounded)


def csv_line(edges: DataFrame, attrs: list[str]) -> Column:
    head = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FIXED]
    kinds = dict(edges.dtypes)
    body = [F.coalesce(F.col(a), F.lit("")) if kinds[a] == "string" else number_text(F.col(a).cast("double")) for a in attrs]
    return F.concat_ws(",", *head, *body)


def write_csv(edges: DataFrame, path: str, attrs: list[str], files: int = 8) -> None:
    """Shards in time order, each with a header."""
    lines = edges.repartitionByRange(files, "t").sortWithinPartitions("t", "src", "dst", "event_type").select(csv_line(edges, attrs).alias(",".join([*FIXED, *attrs])))
    lines.write.mode("overwrite").option("header", True).option("quote", "").option("sep", "\x01").csv(path)


def read_csv(spark: SparkSession, path: str, attrs: list[str]) -> DataFrame:
    """Lenient: unreadable ids and times become sentinels, unreadable attributes null."""
    raw = spark.read.text(path)
    head = ",".join([*FIXED, *attrs])
    f = raw.where((F.col("value") != head) & (F.col("value") != "")).select(F.split("value", ",").alias("f"))
    at = lambda k, kind: F.try_element_at("f", F.lit(k + 1)).try_cast(kind)
    cols = [F.coalesce(at(0, "bigint"), F.lit(BAD_ID)).alias("src"), F.coalesce(at(1, "bigint"), F.lit(BAD_ID)).alias("dst"), F.coalesce(at(2, "bigint"), F.lit(BAD_TIME)).alias("t"), at(3, "string").alias("event_type"), at(4, "string").alias("label"), at(5, "bigint").alias("anomaly_id")]
    return f.select(*cols, *[at(6 + k, "double").alias(a) for k, a in enumerate(attrs)])


def write_parquet(edges: DataFrame, path: str, rows_per_file: int = 4_000_000, files: int | None = None) -> None:
    """Range-partitioned and sorted by (t, src, dst, event_type), so that readers can skip row groups by time."""
    order = ["t", "src", "dst", "event_type"]
    ranged = edges.repartitionByRange(files, "t") if files else edges.repartitionByRange("t")
    ranged.sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Edges of all shards; unsigned ids (read as decimals) become bigint. Extra columns are kept."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(*([path] if isinstance(path, str) else path))
    return df.select(*[F.col(c).cast("bigint").alias(c) if kind.startswith("decimal(20") else F.col(c) for c, kind in df.dtypes])


def load_edges(spark: SparkSession, path: str, event_type: str | None = None) -> DataFrame:
    """src, dst, t of an output directory; the filter and the columns reach the scan."""
    df = read_parquet(spark, path)
    return (df if event_type is None else df.where(F.col("event_type") == event_type)).select("src", "dst", F.col("t").cast("double").alias("t"))


def read_stream_order(spark: SparkSession, path: str) -> DataFrame:
    """Edges with id, their place in the written order: files by name, rows within."""
    meta = spark.read.option("recursiveFileLookup", "true").parquet(path).select("*", F.col("_metadata.file_path").alias("file_"), F.col("_metadata.row_index").alias("row_"))
    files = [r[0] for r in meta.select("file_").distinct().orderBy("file_").collect()]  # one name a file
    number = spark.createDataFrame(list(enumerate(files)), "file_no bigint, file_name string")
    out = meta.join(F.broadcast(number), F.col("file_") == F.col("file_name"))
    return out.withColumn("id", F.col("file_no") * F.lit(1 << 40) + F.col("row_")).drop("file_", "row_", "file_no", "file_name")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of all shards (edges_*) of a folder, or of its one table edges; FileNotFoundError if it has neither."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "edges*")) or []
    names = sorted(str(f.getPath()) for f in found if f.getPath().getName().startswith(("edges_", "edges.")) or f.getPath().getName() == "edges")
    if not names:
        raise FileNotFoundError(f"{folder}: no edges or edges_* in it")
    return read_parquet(spark, names)


def tee(df: DataFrame, *writes) -> None:
    """One computation, several sinks: the rows are cut from their lineage once, and each function writes from there."""
    from chronoloom.session import cut

    rows = cut(df)
    for write_one in writes:
        write_one(rows)


def counted(df: DataFrame, name: str = "rows"):
    """df that counts its rows as they pass, and the Observation that holds the count after the first action."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def nodes_csv(nodes: DataFrame, state: list[str]) -> Column:
    """A node table's line: id, attributes, then state variables as numbers."""
    kinds = dict(nodes.dtypes)
    cell = lambda c: number_text(F.col(c).cast("double")) if c in state or kinds[c] in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat_ws(",", *[cell(c) for c in nodes.columns])


def write_nodes_csv(nodes: DataFrame, path: str, state: list[str]) -> None:
    nodes.sort("id").select(nodes_csv(nodes, state).alias(",".join(nodes.columns))).write.mode("overwrite").option("header", True).option("quote", "").option("sep", "\x01").csv(path)


def read_edge_list(spark: SparkSession, path: str, src: int | str = 0, dst: int | str = 1, t: int | str | None = None, scale: float = 1.0) -> DataFrame:
    """A foreign edge list: delimiter (comma, tab or blanks) and header found from its first line. Columns by number or by
    name; time is the last column if it isn't given, and with t="index" the rows' order in the file."""
    from chronoloom.operators.ranges import running
    from chronoloom.operators.relational import dense_ids

    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    raw = raw.where("value <> '' and not startswith(value, '#') and not startswith(value, '%')")
    first = raw.orderBy("file", "at").first()
    line = first[0] if first else ""
    sep = "," if "," in line else "\t" if "\t" in line else r"\s+"
    import re

    parts = re.split(sep, line.strip())
    by_name = any(isinstance(c, str) and c != "index" for c in (src, dst, t))
    place = lambda c: parts.index(c) if isinstance(c, str) and c != "index" else c
    if by_name:
        raw = raw.where(F.col("value") != line)
    src, dst, t = place(src), place(dst), len(parts) - 1 if t is None else place(t)
    rows = raw.select(F.split(F.trim("value"), sep).alias("f"), "file", "at")
    ends = (F.get("f", F.lit(src)).alias("src"), F.get("f", F.lit(dst)).alias("dst"))
    if t == "index":
        rows = running(rows.select(*ends, "file", "at"), ["file", "at"], n=F.lit(1).cast("bigint"))
        named = rows.select("src", "dst", ((F.col("n") - 1) * scale).cast("double").alias("t"))
    else:
        named = rows.select(*ends, (F.get("f", F.lit(t)).try_cast("double") * scale).alias("t"))
    return dense_ids(named.where("t is not null")).select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "t")


def find_edge_lists(folder: str) -> list[str]:
    """Files that look like edge lists, class and feature files left out."""
    names = {f for p in ("*edgelist*", "*edges*", "*temporal*", "*.txt*", "*.csv*") for f in glob.glob(f"{folder}/{p}")}
    return sorted(f for f in names if not any(w in Path(f).name for w in ("classes", "features")))


def xml_text(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def graphml_lines(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """section, row, line: header, nodes, edges with their data, footer. nodes: id; edges: id, src, dst and the keys."""
    spark = nodes.sparkSession
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *[f'<key id="{k}" for="edge" attr.name="{k}" attr.type="string"/>' for k in keys], '<graph id="G" edgedefault="directed">']
    top = spark.createDataFrame([(0, n, x) for n, x in enumerate(head)], "section int, row bigint, line string")
    end = spark.createDataFrame([(3, 0, "</graph></graphml>")], "section int, row bigint, line string")
    node = nodes.select(F.lit(1).alias("section"), F.col("id").alias("row"), F.concat(F.lit('<node id="n'), "id", F.lit('"/>')).alias("line"))
    data = [F.concat(F.lit(f'<data key="{k}">'), xml_text(F.col(k).cast("string")), F.lit("</data>")) for k in keys]
    edge = edges.select(F.lit(2).alias("section"), F.col("id").alias("row"), F.concat(F.lit('<edge source="n'), "src", F.lit('" target="n'), "dst", F.lit('">'), F.concat_ws("", *data), F.lit("</edge>")).alias("line"))
    return top.unionAll(node).unionAll(edge).unionAll(end)


def write_graphml(nodes: DataFrame, edges: DataFrame, keys: list[str], path: str) -> None:
    """One document in part files that are read in name order."""
    graphml_lines(nodes, edges, keys).orderBy("section", "row").select("line").write.mode("overwrite").text(path)


def node_labels(instances: DataFrame) -> DataFrame:
    """A row for each member of each instance (members: array)."""
    return instances.select(F.explode("members").alias("node_id"), "intent", "kind", F.col("id").alias("anomaly_id"))


def ground_truth_json(edges: DataFrame, instances: DataFrame) -> dict:
    """Intent names, edges of each and instances: metadata, so it is made on the driver."""
    counts = {r["label"]: r["n"] for r in edges.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()}
    return {"intents": sorted(counts), "edges_per_intent": counts, "instances": [json.loads(x) for x in instances.orderBy("id").toJSON().collect()]}


def prometheus(edges: DataFrame, prefix: str = "graph") -> DataFrame:
    """Lines of the text exposition format: totals and a series for each type and label."""
    total = edges.agg(F.count("*").alias("n")).select(F.concat(F.lit(f"{prefix}_edges_total "), F.col("n")).alias("line"))
    series = lambda c, name: edges.groupBy(c).agg(F.count("*").alias("n")).select(F.concat(F.lit(f'{prefix}_{name}_total{{{c}="'), F.col(c), F.lit('"} '), F.col("n")).alias("line"))
    return total.unionAll(series("event_type", "events")).unionAll(series("label", "labels"))


def write(edges: DataFrame, path: str, kind: str, attrs: list[str] | None = None, nodes: DataFrame | None = None) -> None:
    attrs = attrs or []
    writers = {"parquet": lambda: write_parquet(edges, path), "csv": lambda: write_csv(edges, path, attrs), "graphml": lambda: write_graphml(nodes, edges, ["event_type", "label", *attrs], path)}
    if kind not in writers:
        raise ValueError(f"no such format: {kind} (one of {', '.join(writers)})")
    writers[kind]()
