r"""Chat formatting: schema fingerprints select declarative mappings into canonical turns, which a template renders.

A record is JSON. Its nested field paths are hashed, and the first mapping whose own paths are among these hashes turns it
into turns (role, text); further keys are carried by any record and change nothing. Contents may be texts or lists of parts. Turns are rendered as ``### role``, line feed, text, ``</turn>``, line feed. Inside
texts and roles a backslash, ``###`` and ``</turn>`` are written as ``\\``, ``\h`` and ``\e``, a line feed inside a
role as ``\n``; every backslash thus starts one pair, and reading back is exact.

Defined cases: null text or role is empty; a record of an unknown layout or broken JSON gives no turns and is told
by ``unmapped``; turns are
ordered by number, nulls first, then role and text, so repeated rows are repeated turns; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN = "struct<at:bigint,role:string,text:string>"
END = "</turn>\n"


def _turn(role: Column, text: Column, at: Column) -> Column:
    return F.struct(at.cast("bigint").alias("at"), role.alias("role"), text.alias("text"))


def _said(content: Column) -> Column:
    """The text of a content: a text, or the texts of its parts one after another."""
    parts = F.try_variant_get(content, "$", "array<variant>")
    texts = F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")), F.lit("")))
    return F.when(F.schema_of_variant(content).startswith("ARRAY"), F.array_join(texts, "")).otherwise(F.try_variant_get(content, "$", "string"))


def _listed(path: str, role: str, text: str) -> Callable[[Column], Column]:
    def turns(v: Column) -> Column:
        items = F.try_variant_get(v, f"$.{path}", "array<variant>")
        known = F.create_map(*[F.lit(x) for x in ("human", "user", "gpt", "assistant", "bot", "assistant", "model", "assistant")])
        own = lambda m: F.try_variant_get(m, f"$.{role}", "string")
        return F.transform(items, lambda m, i: _turn(F.coalesce(F.try_element_at(known, own(m)), own(m)), _said(F.try_variant_get(m, f"$.{text}", "variant")), i))

    return turns


def _exchange(prompt: list[str], answer: str) -> Callable[[Column], Column]:
    def turns(v: Column) -> Column:
        get = lambda name: F.try_variant_get(v, f"$.{name}", "string")
        asked = F.array_join(F.filter(F.array(*[get(p) for p in prompt]), lambda s: s.isNotNull() & (s != "")), "\n\n")
        return F.array(_turn(F.lit("user"), asked, F.lit(0)), _turn(F.lit("assistant"), get(answer), F.lit(1)))

    return turns


def _single(v: Column) -> Column:
    return F.array(_turn(F.try_variant_get(v, "$.role", "string"), F.try_variant_get(v, "$.text", "string"), F.try_variant_get(v, "$.turn", "bigint")))


#: Layout: (name, the paths that it needs, mapping to turns); of several that fit the first counts. ``[]`` is every item of a list.
LAYOUTS: list[tuple[str, tuple[str, ...], Callable[[Column], Column]]] = [
    ("messages", ("messages[].content", "messages[].role"), _listed("messages", "role", "content")),
    ("from_value", ("conversations[].from", "conversations[].value"), _listed("conversations", "from", "value")),
    ("turn_row", ("role", "text"), _single),
    ("instruction", ("input", "instruction", "output"), _exchange(["instruction", "input"], "output")),
    ("instruction_only", ("instruction", "output"), _exchange(["instruction"], "output")),
    ("prompt_response", ("prompt", "response"), _exchange(["prompt"], "response")),
    ("prompt_completion", ("completion", "prompt"), _exchange(["prompt"], "completion")),
    ("question_answer", ("answer", "question"), _exchange(["question"], "answer")),
]


def _has(v: Column, path: str) -> Column:
    """Whether the record has the path; a path through a list has to be in all of its items, of which there is one at least."""
    outer, listed, inner = path.partition("[].")
    if not listed:
        return F.try_variant_get(v, f"$.{path}", "variant").isNotNull()
    items = F.try_variant_get(v, f"$.{outer}", "array<variant>")
    return (F.size(items) > 0) & F.forall(items, lambda m: F.try_variant_get(m, f"$.{inner}", "variant").isNotNull())


def path_hashes(v: Column) -> Column:
    """Hashes of those paths of a record that layouts know, in order."""
    known = sorted({p for _, paths, _ in LAYOUTS for p in paths})
    return F.array_compact(F.array(*[F.when(_has(v, p), F.xxhash64(F.lit(p))) for p in known]))


def _layout(prints: Column) -> Column:
    """Number of the first layout whose paths are among the hashes; null if none is."""
    found = F.lit(None).cast("int")
    for n, (_, paths, _) in reversed(list(enumerate(LAYOUTS))):
        found = F.when(F.forall(F.array(*[F.xxhash64(F.lit(p)) for p in paths]), lambda h: F.array_contains(prints, h)), n).otherwise(found)
    return found


def canonical_turns(records: DataFrame, key: str, record: str) -> DataFrame:
    """(key, at, role, text, layout): one row per turn of the JSON records."""
    parsed = records.select(F.col(key).alias("own_key"), F.try_parse_json(F.col(record)).alias("v"))
    chosen = parsed.select("own_key", "v", _layout(path_hashes(F.col("v"))).alias("n"))
    turns, layout = F.lit(None).cast(f"array<{TURN}>"), F.lit(None).cast("string")
    for n, (name, _, mapping) in enumerate(LAYOUTS):
        own = F.col("n") == n
        turns, layout = F.when(own, mapping(F.col("v")).cast(f"array<{TURN}>")).otherwise(turns), F.when(own, F.lit(name)).otherwise(layout)
    flat = chosen.select("own_key", layout.alias("layout"), F.explode(turns).alias("t"))
    return flat.select(F.col("own_key").alias(key), F.col("t.at").alias("at"), F.coalesce("t.role", F.lit("")).alias("role"), F.coalesce("t.text", F.lit("")).alias("text"), "layout")


def unmapped(records: DataFrame, record: str) -> DataFrame:
    """(fingerprint, paths, records): how many records no layout fits, by all their nested field paths; broken JSON has null paths."""
    v = F.try_parse_json(F.col(record))
    lost = records.select(v.alias("v")).where(_layout(path_hashes(F.col("v"))).isNull())
    paths = F.regexp_replace(F.schema_of_variant("v"), r": (?!OBJECT<|ARRAY<)[A-Z_]+(\(\d+, ?\d+\))?", "")
    return lost.groupBy(paths.alias("paths")).agg(F.count("*").alias("records")).select(F.xxhash64("paths").alias("fingerprint"), "paths", "records")


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("###"), F.lit("\\h")), F.lit("</turn>"), F.lit("\\e"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescape(text: Column) -> Column:
    """Pairs of backslashes first, from the left: what is between them has only the other pairs."""
    plain = lambda s: F.replace(F.replace(F.replace(s, F.lit("\\h"), F.lit("###")), F.lit("\\e"), F.lit("</turn>")), F.lit("\\n"), F.lit("\n"))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def format_chats(turns: DataFrame, key: str, trained: str = "assistant") -> DataFrame:
    """(key, formatted, loss): the rendered conversation and the spans (start, length in code points) of the trained
    role's texts. A conversation is one row of the result, so its turns meet in one task."""
    head = F.concat(F.lit("### "), escape(F.col("role"), role=True), F.lit("\n"))
    body = escape(F.col("text"))
    order = Window.partitionBy(key).orderBy("at", "role", "text")
    pieces = turns.select(key, "at", "role", "text", head.alias("head"), body.alias("body"))
    size = F.length("head") + F.length("body") + len(END)
    placed = pieces.withColumn("n", F.row_number().over(order)).withColumn("start", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - len(END) - F.length("body"))
    span = F.struct((F.col("start") + 1).alias("start"), F.length("body").cast("long").alias("length"))
    grouped = placed.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("n", F.concat("head", "body", F.lit(END)).alias("piece")))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(F.col("role") == trained, F.struct("n", span.alias("span"))))).alias("spans"),
    )
    return grouped.select(key, F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), F.transform("spans", lambda s: s["span"]).alias("loss"))


def read_back(formatted: Column) -> Column:
    """Array of (role, text) of a rendered conversation."""
    parts = F.split(formatted, END, -1)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), _read_turn)


def _read_turn(part: Column) -> Column:
    line = F.instr(part, F.lit("\n"))
    return F.struct(unescape(F.substring(part, F.lit(5), line - 5)).alias("role"), unescape(F.substring(part, line + 1, F.length(part))).alias("text"))


def masked_text(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the loss spans, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"].cast("int"), s["length"].cast("int")))), "")
