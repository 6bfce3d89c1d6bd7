"""A corpus of lockfiles of any size: read by lines and JSON entries, so that one huge file is many rows in many tasks.

Lines are numbered in the order of their files, and what a format carries from line to line (a section, the last name, the
last version) is combined over chunks of CHUNK lines: within a chunk by a window, over the chunks of a file by a window of
their last values. So no window holds more than a chunk's lines, or one row for each chunk of a file.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import supply as sp
from ..tables import numbered, written
from .archives import BROKEN, read_archive

CHUNK = 4096
#: Places in a line that may begin a block, at most.
PLACES = 1 << 20
_DEPENDENCY = "(?=<dependency>)|(?<=</dependency>)"
#: Where the packages of the JSON formats are, and the type of an entry.
_JSON = {"composer": ("packages", "struct<name:string,version:string>"), "maven_json": ("dependencies", "struct<groupId:string,artifactId:string,version:string>"), "nuget": ("dependencies", "struct<resolved:string>"), "mix": ("", "variant")}


def carry_over(df: DataFrame, chunk: int | None = None, firsts: tuple[str, ...] = (), **values: Column) -> DataFrame:
    """Adds the last filled value (of ``firsts`` the first one) at the earlier rows of each row's file, by pos, chunk by chunk."""
    at = F.expr(f"pos div {chunk or CHUNK}")
    own = Window.partitionBy("filename", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({"chunk": at, **{f"{k}_now": v for k, v in values.items()}})
    end = lambda k: F.first if k in firsts else F.last
    filled = lambda k: (F.min_by if k in firsts else F.max_by)(f"{k}_now", F.when(F.col(f"{k}_now").isNotNull(), F.col("pos"))).alias(k)
    ends = df.groupBy("filename", "chunk").agg(*map(filled, values))
    before = Window.partitionBy("filename").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    prior = ends.select(F.col("filename").alias("f"), F.col("chunk").alias("c"), *(end(k)(k, True).over(before).alias(f"{k}_prior") for k in values))
    inside = df.withColumns({k: end(k)(f"{k}_now", True).over(own) for k in values})
    met = inside.join(prior, (F.col("filename") == F.col("f")) & (F.col("chunk") == F.col("c")))
    return met.withColumns({k: F.coalesce(f"{k}_prior", k) if k in firsts else F.coalesce(k, f"{k}_prior") for k in values}).drop("chunk", "f", "c", *(f"{k}_{x}" for k in values for x in ("now", "prior")))


def _name(path: Column, root: str) -> Column:
    """The path below the folder of the corpus."""
    plain = F.when(path.contains("%"), F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))).otherwise(path)
    return F.regexp_replace(F.regexp_replace(plain, "^[a-z0-9]+:/*", "/"), "^" + _quoted(root), "")


def _quoted(root: str) -> str:
    folder = "/" + root.partition(":")[2].lstrip("/") if ":" in root.split("/")[0] else root
    return "\\Q" + folder.rstrip("/") + "\\E/"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(filename, format, ecosystem, pos, raw) of the lines of all lockfiles that are not JSON, written by format; pos orders those of a file.

    A file that one task reads whole has its lines in the task's order. Only lines of files that are split are sorted.
    """
    names = [n for n, (kind, _) in sp.LOCKFILES.items() if kind not in _JSON]
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(names) + "}").text(path)
    block = F.col("_metadata.file_block_start").alias("start"), (F.col("_metadata.file_block_length") == F.col("_metadata.file_size")).alias("whole")
    at = F.monotonically_increasing_id().bitwiseAND(2**33 - 1).alias("pos")
    rows = text.select(_name(F.col("_metadata.file_path"), path).alias("filename"), *block, at, F.when(F.col("value").contains("\r"), F.regexp_replace("value", "\\r$", "")).otherwise(F.col("value")).alias("raw"))
    columns = ("filename", "format", "ecosystem", "pos", "raw")
    held = written(sp.with_format(rows).repartition("filename", "start"), "lines", "format")
    parts = held.where("not whole")
    if parts.isEmpty():
        return held.select(*columns)
    sorted_parts = numbered(parts.withColumnRenamed("pos", "at"), "filename", "start", "at", name="pos")
    return held.where("whole").select(*columns).unionByName(written(sorted_parts.select(*columns), "lines", "format"))


def _pieces(lines: DataFrame, between: str) -> DataFrame:
    """Lines cut at the places that ``between`` matches; pos orders the pieces, and the last of a line ends it."""
    cut = lines.withColumn("cut", F.split("raw", between, -1)).select("filename", "ecosystem", F.col("pos").alias("nth"), F.size("cut").alias("n"), F.posexplode("cut").alias("k", "b"))
    return cut.select("filename", "ecosystem", (F.col("nth") * PLACES + F.col("k")).alias("pos"), "k", (F.col("k") + 1 == F.col("n")).alias("ends"), "b")


def toml_blocks(lines: DataFrame) -> DataFrame:
    """Packages of [[package]] blocks: the first name and version of each, gathered by block with partial results."""
    parts = _pieces(lines, sp.TOML_BLOCK).withColumns({"name": sp.toml_first("name"), "version": sp.toml_first("version")})
    parts = parts.where("k > 0 or name != '' or version != ''").drop("b", "ends")
    placed = carry_over(parts, CHUNK * PLACES, block=F.when(F.col("k") > 0, F.col("pos")))
    placed = placed.withColumn("block", F.when(F.col("k") > 0, F.col("pos")).otherwise(F.col("block"))).where("block is not null")
    first = lambda field: F.min_by(field, F.when(F.col(field) != "", F.col("pos"))).alias(field)
    found = placed.groupBy("filename", "ecosystem", "block").agg(first("name"), first("version"))
    return found.where("name is not null and version is not null").select("filename", F.col("block").alias("pos"), "name", "version", "ecosystem")


def pom_blocks(lines: DataFrame) -> DataFrame:
    """Packages of <dependency> elements: from an opening that is not inside another one to the first closing."""
    parts = _pieces(lines, _DEPENDENCY).withColumns({"opens": F.col("b").startswith("<dependency>"), "closes": F.col("b").endswith("</dependency>")})
    state = F.when(F.col("closes"), False).when(F.col("opens"), True)
    placed = carry_over(parts, CHUNK * PLACES, inside=state).withColumn("inside", F.coalesce("inside", F.lit(False)))
    begins = F.col("opens") & ~F.col("inside")
    placed = written(placed.withColumn("begins", F.when(begins, F.col("pos"))).where("inside or begins is not null"), "elements")
    placed = carry_over(placed, CHUNK * PLACES, block=F.col("begins")).withColumn("block", F.coalesce("begins", "block"))
    closed = placed.where("closes").select(F.col("filename").alias("f"), F.col("block").alias("c")).distinct()
    whole = placed.join(closed, (F.col("filename") == F.col("f")) & (F.col("block") == F.col("c")), "left_semi")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat("b", F.when(F.col("ends"), "\n").otherwise("")).alias("b")))), lambda x: x["b"]), "")
    return sp.pom_packages(whole.groupBy("filename", "ecosystem", F.col("block")).agg(body.alias("b")).withColumnRenamed("block", "pos"))


def json_entries(spark: SparkSession, path: str) -> DataFrame:
    """(filename, format, ecosystem, pos, key, value) of the entries of all JSON lockfiles, read once; a file that is broken gives none."""
    names = {n: kind for n, (kind, _) in sp.LOCKFILES.items() if kind in _JSON}
    at = json.dumps({n: [k for k in [_JSON[kind][0]] if k] for n, kind in names.items()})
    pattern = "(^|/)(" + "|".join(n.replace(".", "[.]") for n in names) + ")$"
    rows = read_archive(spark, path, "entries", at=at, lenient="true", names=pattern)
    named = rows.select(F.regexp_replace("archive", "^" + _quoted(path), "").alias("filename"), F.col("nth").alias("pos"), "key", "value")
    held = written(sp.with_format(named), "entries", "format")
    # names of broken files are fewer than those that the reader lists; sending them spares a shuffle of all entries
    broken = F.broadcast(held.where(F.col("key") == BROKEN).select("filename").distinct())
    return held.join(broken, "filename", "left_anti").where("value is not null")


def packages_of_entries(entries: DataFrame, kind: str) -> DataFrame:
    """Packages of the entries of one JSON format."""
    entry = _JSON[kind][1]
    parsed = F.try_parse_json("value") if entry == "variant" else F.from_json("value", entry)
    listed = kind in ("composer", "maven_json")
    e = parsed if listed else F.struct("key", parsed.alias("value"))
    shaped = entries.where(F.col("format") == kind).where("key is null" if listed else "key is not null")
    return sp.json_packages(shaped.select("filename", "ecosystem", "pos", e.alias("e")))


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """(filename, pos, name, version, ecosystem) of every package in the lockfiles below a folder; pos orders those of a file."""
    lines, entries = read_lines(spark, path), json_entries(spark, path)
    of = lambda *kinds: lines.where(F.col("format").isin(*kinds))
    parts = [sp.packages_of_lines(of(*sp.LINE_FORMATS), carry_over), toml_blocks(of("toml")), pom_blocks(of("pom")), *(packages_of_entries(entries, k) for k in _JSON)]
    columns = ("filename", "pos", "name", "version", "ecosystem")
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])
