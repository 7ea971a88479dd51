"""Chat formatting by schema fingerprints. DataFrame functions only.

A layout is the set of its nested field paths (arrays as ``[]``); its fingerprint is the hash of those that
belong to mappings it has all paths of. A dictionary from fingerprints (LAYOUTS) selects the declarative mapping that turns prompt, instruction and message layouts into
canonical turns ``ARRAY<STRUCT<role, text>>``. The template marks turns and escapes control
strings, so the formatted text gives the turns back exactly.

Null text is an empty text, and so is a null role. Turns are ordered by turn (null first), then
role, then text; repeated rows are repeated turns. A layout no mapping fits gives null turns for a
JSON row, which format_turns() marks, and an error for a table; a JSON list of messages without items names no fields and fits none. Fields no mapping names are ignored, so they never clash.
An empty table gives no rows. A conversation's rows meet in one row, as its formatted text does.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role: string, text: string>>"
OPEN, SEP, CLOSE = "### ", ": ", " </turn>\n"
#: Control characters and the letters that stand for them behind a backslash; the backslash first.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The paths of all leaves below a type."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """paths: the layout. turns: (role expression, text expression) in order, or the array of messages and its two fields."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    messages: tuple[str, str, str] = ()
    by_turn: tuple[str, str, str, str] = ()

    @property
    def print(self) -> str:
        return fingerprint(list(self.paths))


#: role is a literal; text names a field. An empty optional text gives no turn where listed in OPTIONAL.
MAPPINGS = (
    Mapping("turn_rows", ("conv_id", "role", "text", "turn"), by_turn=("conv_id", "turn", "role", "text")),
    Mapping("prompt_response", ("prompt", "response"), turns=(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", ("completion", "prompt"), turns=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("question_answer", ("answer", "question"), turns=(("user", "question"), ("assistant", "answer"))),
    Mapping("instruction_output", ("instruction", "output"), turns=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input_output", ("input", "instruction", "output"), turns=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("system_prompt_response", ("prompt", "response", "system"), turns=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("messages", ("messages[].content", "messages[].role"), messages=("messages", "role", "content")),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), messages=("conversations", "from", "value")),
    Mapping("turns", ("turns[].role", "turns[].text"), messages=("turns", "role", "text")),
)
#: Roles of other layouts and what they are called here.
ROLES = {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant"}


def known_paths(have: set[str]) -> list[str]:
    """The paths of all mappings that a layout has completely, sorted."""
    return sorted({p for m in MAPPINGS if have.issuperset(m.paths) for p in m.paths})


def _layouts() -> dict[str, Mapping]:
    """Fingerprint -> mapping for every layout that known_paths() can give; of several mappings the one with most paths, then the first."""
    made: dict[str, Mapping] = {}
    for n in range(1, len(MAPPINGS) + 1):
        for some in combinations(MAPPINGS, n):
            paths = known_paths({p for m in some for p in m.paths})
            made[fingerprint(paths)] = max((m for m in MAPPINGS if set(paths).issuperset(m.paths)), key=lambda m: len(m.paths))
    return made


LAYOUTS = _layouts()


def select_mapping(schema: T.StructType) -> Mapping:
    """The mapping that the schema's fingerprint stands for."""
    have = set(field_paths(schema))
    found = LAYOUTS.get(fingerprint(known_paths(have)))
    if found is None:
        raise ValueError(f"no mapping for the layout {fingerprint(sorted(have))}: {sorted(have)}")
    return found


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _role(c: Column) -> Column:
    out = c
    for other, ours in ROLES.items():
        out = F.when(c == other, F.lit(ours)).otherwise(out)
    return out


def _turns(m: Mapping, field) -> Column:
    if m.messages:
        top, role, text = m.messages
        return F.transform(F.coalesce(field(top), F.array()), lambda x: _turn(_role(x[role]), x[text]))
    return F.array(*[_turn(F.lit(role), field(text)) for role, text in m.turns])


def canonical_turns(df: DataFrame, key: str | None = None) -> DataFrame:
    """key, turns of a table in any known layout; rows by turn are gathered by their conversation."""
    m = select_mapping(df.schema)
    if m.by_turn:
        conv, turn, role, text = m.by_turn
        rows = df.select(F.col(conv).alias("key"), F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
        turns = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
        return rows.groupBy("key").agg(turns.alias("turns"))
    return df.select((F.col(key) if key else F.lit(None).cast("string")).alias("key"), _turns(m, F.col).alias("turns"))


def _leaf(v: Column, field: str) -> Column:
    """Whether an object has the field as a leaf; null where it lacks it."""
    return ~F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant")).rlike("^(OBJECT|ARRAY)<")


def _fits(m: Mapping, v: Column) -> Column:
    """Whether a JSON value has the paths that the mapping knows, whatever else it has."""
    if not m.messages:
        fits = F.lit(True)
        for _, text in m.turns:
            fits = fits & F.coalesce(_leaf(v, text), F.lit(False))
        return fits
    top, role, text = m.messages
    items = F.coalesce(F.try_variant_get(v, f"$.{top}", "array<variant>"), F.array().cast("array<variant>"))
    fits = F.forall(items, lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT<"), F.lit(False)))
    # an item may lack a field that others have
    some = lambda f: F.exists(items, lambda x: F.coalesce(_leaf(x, f), F.lit(False)))
    none_nested = lambda f: F.forall(items, lambda x: F.coalesce(_leaf(x, f), F.lit(True)))
    return fits & some(role) & some(text) & none_nested(role) & none_nested(text)


def canonical_json(df: DataFrame, payload: str, key: str) -> DataFrame:
    """key, layout, turns of JSON rows, each of any known layout; of mappings that fit, the one with most paths wins. Unknown layouts and broken JSON: null turns."""
    v = F.try_parse_json(F.col(payload))
    drawn = F.regexp_replace(F.schema_of_variant(v), r": (STRING|BIGINT|DOUBLE|BOOLEAN|VOID|DECIMAL\(\d+,\d+\)|VARIANT)", ": x")
    own = [m for m in MAPPINGS if not m.by_turn]
    some = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.when(_fits(m, v), F.array(*map(F.lit, m.paths))).otherwise(F.array().cast("array<string>")) for m in own]))))
    seen = df.select(F.col(key).alias("key"), F.col(payload).alias("payload"), F.sha2(drawn, 256).alias("layout"), F.substring(F.sha2(F.array_join(some, "\n"), 256), 1, 16).alias("print"))
    table = F.create_map(*[F.lit(x) for at, m in LAYOUTS.items() if not m.by_turn for x in (at, m.name)])
    seen = seen.withColumn("mapping", F.try_element_at(table, F.col("print")))
    turns = F.lit(None).cast(TURNS)
    for m in own:
        if m.messages:
            top, role, text = m.messages
            parsed = F.from_json("payload", f"{top} array<struct<`{role}`: string, `{text}`: string>>")
        else:
            parsed = F.from_json("payload", ", ".join(f"`{text}` string" for _, text in m.turns))
        turns = F.when(F.col("mapping") == m.name, _turns(m, lambda f, p=parsed: p[f])).otherwise(turns)
    return seen.select("key", "layout", turns.alias("turns"))


def escape(c: Column, role: bool = False) -> Column:
    for plain, coded in ESCAPES if role else ESCAPES[:3]:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    """The reverse. Behind escape() each backslash has its letter, so no order but the backslash last matters."""
    for plain, coded in reversed(ESCAPES):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def format_turns(df: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """key, formatted STRING, loss_mask ARRAY<STRUCT<start, length>> (0-based code points of formatted). Of rows with a layout also layout and
    unknown BOOLEAN: no mapping fits and the text is empty for that."""
    seg = F.transform(
        F.coalesce(F.col("turns"), F.array().cast(TURNS)),
        lambda t: F.struct(
            F.concat(F.lit(OPEN), escape(t["role"], True), F.lit(SEP)).alias("head"), escape(t["text"]).alias("body"), (t["role"] == loss_role).alias("loss")
        ),
    )
    spans = F.aggregate(
        F.col("segs"),
        F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start: int, length: int>>").alias("mask")),
        lambda a, s: F.struct(
            (a["pos"] + F.length(s["head"]) + F.length(s["body"]) + len(CLOSE)).alias("pos"),
            F.when(s["loss"], F.concat(a["mask"], F.array(F.struct((a["pos"] + F.length(s["head"])).alias("start"), F.length(s["body"]).alias("length"))))).otherwise(a["mask"]).alias("mask"),
        ),
        lambda a: a["mask"],
    )
    whole = F.array_join(F.transform("segs", lambda s: F.concat(s["head"], s["body"], F.lit(CLOSE))), "")
    told = [F.col("layout"), F.col("turns").isNull().alias("unknown")] if "layout" in df.columns else []
    return df.select("key", seg.alias("segs"), *told).select("key", whole.alias("formatted"), spans.alias("loss_mask"), *(["layout", "unknown"] if told else []))


def read_turns(formatted: Column) -> Column:
    """The turns, parsed from the formatted text alone."""
    parts = F.split(formatted, CLOSE, -1)

    def one(part: Column) -> Column:
        body = F.substring(part, F.lit(len(OPEN) + 1), F.length(part))
        role = F.substring_index(body, ":", 1)
        text = F.substring(body, F.length(role) + len(SEP) + 1, F.length(body))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), one)


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"] + 1, m["length"]))), "")


def chat_summary(formatted: DataFrame) -> DataFrame:
    """The digest columns, all read back from format_turns()'s output."""
    turns = read_turns(F.col("formatted"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = formatted.select("key", "formatted", turns.alias("turns"), masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    return back.select(
        F.col("key").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
