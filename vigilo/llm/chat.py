"""Chat formatting, in DataFrame and SQL expressions only.

Records arrive as JSON of different layouts.  A record's schema fingerprint, the hash of those of its nested field
paths that mappings know, selects a declarative mapping that gives canonical turns (role, text).  Turns are written in a template that marks
them; control strings inside texts are escaped reversibly, and stretches of assistant texts form the loss mask.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilo.llm.common import spared

#: The template's marks: a turn is START, role, HEAD, text, END.
START, HEAD, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that must not stand unescaped in a formatted text: the template's own and those of templates in public use.
CONTROL = (START, HEAD, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    ``sample`` shows the layout and so gives its fingerprint.  Either ``items`` names the path of a list of turns with
    the ``role`` and ``text`` fields of each and ``roles`` renames roles, or ``parts`` lists (role, paths): the texts
    at the paths, blank-line separated, null or empty ones left out, make a turn; a part without text makes none
    unless it is the last.
    """

    name: str
    sample: str
    items: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()


MAPPINGS = (
    Mapping("messages", '{"messages":[{"role":"r","content":"t"}]}', "messages", "role", "content"),
    Mapping("conversations", '{"conversations":[{"from":"r","value":"t"}]}', "conversations", "from", "value", (("human", "user"), ("gpt", "assistant"))),
    Mapping("prompt_response", '{"prompt":"p","response":"r"}', parts=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt_completion", '{"prompt":"p","completion":"c"}', parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("instruction", '{"instruction":"i","input":"x","output":"o"}', parts=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("instruction_only", '{"instruction":"i","output":"o"}', parts=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("system_question", '{"system_prompt":"s","question":"q","response":"r"}', parts=(("system", ("system_prompt",)), ("user", ("question",)), ("assistant", ("response",)))),
)


def schema_fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a JSON text: names and nesting, not the types of the leaves.  Null for bad JSON."""
    shape = F.schema_of_variant(F.try_parse_json(record))
    names = F.regexp_replace(shape, r"(?:: |(?<=ARRAY<))(?!OBJECT|ARRAY)[A-Z]+(?:\([0-9,]*\))?", "")
    return F.sha2(names.cast("binary"), 256)


def _paths(m: Mapping) -> tuple[str, ...]:
    """The field paths of a mapping's sample."""
    held = json.loads(m.sample)
    return tuple(sorted([*held, *(f"{m.items}[].{c}" for c in (held[m.items][0] if m.items else ()))]))


def known_paths(record: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """The sorted field paths of a JSON text that some mapping knows; others do not matter.  Null for bad JSON and for what is no object."""
    parsed = F.try_parse_json(record)
    shape = F.schema_of_variant(parsed)
    top = F.json_object_keys(record)
    paths = [F.filter(top, lambda k: k.isin(sorted({p for m in mappings for p in _paths(m) if "[]." not in p})))]
    for items in sorted({m.items for m in mappings if m.items}):
        inner = F.schema_of_variant(F.try_variant_get(parsed, f"$.{items}", "variant"))
        for name in sorted({p.split("[].")[1] for m in mappings if m.items == items for p in _paths(m) if "[]." in p}):
            here = inner.rlike(rf"^ARRAY<OBJECT<(.*, )?{name}: ")
            paths.append(F.when(here, F.array(F.lit(f"{items}[].{name}"))).otherwise(F.array().cast("array<string>")))
    return F.when(shape.startswith("OBJECT"), F.sort_array(F.array_distinct(F.concat(*paths))))


def _hash(paths: Column) -> Column:
    return F.sha2(F.concat_ws("\n", paths).cast("binary"), 256)


def fingerprints_of(spark: SparkSession, mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, str]:
    """name -> fingerprint, from each mapping's sample; a list that long."""
    rows = spark.createDataFrame([(m.name, m.sample) for m in mappings], "name string, sample string")
    return {r[0]: r[1] for r in rows.select("name", _hash(known_paths(F.col("sample"), mappings))).collect()}


def unknown_layouts(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(fingerprint, shape, n): the whole schemas of the records that ``canonical`` gives no turns, and how many have each.

    Bad JSON and null records have null for both.
    """
    lost = canonical(records.select(record), record, mappings).where("turns is null")
    return lost.groupBy(schema_fingerprint(F.col(record)).alias("fingerprint"), F.schema_of_variant(F.try_parse_json(record)).alias("shape")).agg(F.count("*").alias("n"))


def _turns(m: Mapping, record: Column) -> Column:
    if m.items:
        inner = f"array<struct<`{m.role}`:string,`{m.text}`:string>>"
        parsed = F.from_json(record, f"`{m.items}` {inner}")[m.items]

        def turn(x: Column) -> Column:
            role = F.coalesce(x[m.role], F.lit(""))
            for old, new in m.roles:
                role = F.when(x[m.role] == old, F.lit(new)).otherwise(role)
            return F.struct(role.alias("role"), F.coalesce(x[m.text], F.lit("")).alias("text"))

        return F.transform(parsed, turn)
    fields = list(dict.fromkeys(f for _, paths in m.parts for f in paths))
    parsed = F.from_json(record, ", ".join(f"`{f}` string" for f in fields))
    made = []
    for k, (role, paths) in enumerate(m.parts):
        text = F.concat_ws("\n\n", *(F.nullif(parsed[p], F.lit("")) for p in paths))
        one = F.array(F.struct(F.lit(role).alias("role"), text.alias("text")))
        made.append(one if k == len(m.parts) - 1 else F.when(F.length(text) > 0, one).otherwise(F.array().cast(TURNS)))
    return F.concat(*made)


def canonical(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records`` with ``layout`` and ``turns``: array of (role, text) by the mapping its fingerprint selects.

    Fields that no mapping knows are ignored.  A record whose known paths are those of no mapping goes to the first
    whose fields it has all of; of a list of turns only the list itself is needed, and it may be empty.  Other
    layouts, bad JSON and null records have layout null and null turns: ``unknown_layouts`` counts them.  Null roles
    and texts become empty.  Repeated rows are kept, an empty table gives an empty result, and an input column named
    layout or turns is kept with an underscore at its end.
    """
    known = fingerprints_of(records.sparkSession, mappings)
    paths = known_paths(F.col(record), mappings)
    marked = spared(records, *({"layout", "turns", "__paths"} - {record})).withColumn("__paths", paths).withColumn("__fp", _hash(F.col("__paths")))
    exact, partly, turns = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in reversed(mappings):
        exact = F.when(F.col("__fp") == known[m.name], F.lit(m.name)).otherwise(exact)
        needed = F.array(*map(F.lit, [m.items] if m.items else _paths(m)))
        partly = F.when(F.size(F.array_except(needed, "__paths")) == 0, F.lit(m.name)).otherwise(partly)
    laid = marked.withColumn("layout", F.when(F.col("__paths").isNotNull(), F.coalesce(exact, partly)))
    for m in reversed(mappings):
        turns = F.when(F.col("layout") == m.name, _turns(m, F.col(record)).cast(TURNS)).otherwise(turns)
    return laid.withColumn("turns", turns).drop("__fp", "__paths")


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|/" else c for c in s)


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one after the first character of each control string."""
    heads: dict[str, list[str]] = {}
    for c in CONTROL:
        heads.setdefault(c[0], []).append(_quoted(c[1:]))
    pattern = "|".join(f"{_quoted(h)}(?={'|'.join(rest)})" for h, rest in heads.items())
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), f"({pattern})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), escape(t.role), F.lit(HEAD), escape(t.text), F.lit(END))), "")


def formatted(canonical_turns: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss_mask``: per turn, (skip, length) in characters after its START mark.

    The masked stretch is an assistant's text as written, escapes included; other turns have length 0.  Null turns
    stay null; no turns give an empty text.
    """
    mask = F.transform(
        "turns",
        lambda t: F.struct(
            (F.length(escape(t.role)) + len(HEAD)).alias("skip"),
            F.when(t.role == "assistant", F.length(escape(t.text))).otherwise(0).alias("length"),
        ),
    )
    return spared(canonical_turns, "formatted", "loss_mask").withColumn("formatted", format_turns(F.col("turns"))).withColumn("loss_mask", mask)


def read_back(df: DataFrame) -> DataFrame:
    """Adds ``read_turns`` and ``loss_text``, parsed from ``formatted`` and ``loss_mask`` alone."""
    cut = F.filter(F.split("formatted", _quoted(START)), lambda s: F.length(s) > 0)

    def turn(s: Column) -> Column:
        role, text = F.substring_index(s, HEAD, 1), F.substring_index(s, HEAD, -1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(text, F.lit(1), F.length(text) - len(END))).alias("text"))

    df = spared(df, "read_turns", "loss_text", "__cut").withColumn("__cut", cut)
    lost = F.zip_with("__cut", "loss_mask", lambda s, m: unescape(F.substring(s, m.skip + 1, m.length)))
    return df.withColumn("read_turns", F.transform("__cut", turn)).withColumn("loss_text", F.array_join(lost, "")).drop("__cut")
