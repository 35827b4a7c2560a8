"""Chat formatting by schema fingerprints (operator 4), DataFrame functions only.

A record is a JSON text in one of several layouts. Its *fingerprint* is the hash of those of its
nested field paths that any mapping asks for (names and nesting, without value types); the fingerprint selects a declarative
``Mapping`` that says where the turns are and how roles are named. Other fields, at any depth, do not count, so records with
ids, names or scores beside the turns keep their layout; a mapping's optional paths may be missing. Records whose paths
match no mapping, or parts of two, are returned with ``status`` = ``unknown`` and all their paths, so that a new layout
can be declared.

Canonical turns are rendered with a template of my own:

    ### <role>:
    <escaped text>
    </turn>

Control strings inside texts (``###``, ``</turn>``, and the backslash itself) get a backslash in front, so the
rendering can be read back exactly: a turn ends at a newline, ``</turn>``, newline, which no escaped
text contains. In roles newlines are escaped too. The loss mask is a list of [start, length) code point ranges of
the rendering: the texts of the assistant's turns.

Cases: null texts and roles are empty strings; conversations without turns render to an
empty string; rows of a conversation that repeat a turn number are ordered by role and text; a null
conversation id is a conversation of its own; other columns are ignored; texts of any length; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlens.llm.quality_rules import let

CONTROL = "(\\\\|###|</turn>)"
END = "\n</turn>\n"
LOSS_ROLE = "assistant"


@dataclass(frozen=True)
class Mapping:
    """Where the turns of a layout are. Either ``list_path`` with ``role`` and ``text`` fields of
    its elements, or ``fields``: (role, path) pairs in order; an absent or null field is no turn. ``optional`` names
    paths of ``fields`` that may be missing."""

    name: str
    list_path: str | None = None
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()

    @property
    def paths(self) -> tuple[str, ...]:
        """Every path that the mapping asks for; ``a[]`` are the elements of a list, ``a[].b`` their fields b."""
        return (self.list_path, f"{self.list_path}[]", f"{self.list_path}[].{self.role}", f"{self.list_path}[].{self.text}") if self.list_path else tuple(p for _, p in self.fields)

    @property
    def layouts(self) -> list[tuple[str, ...]]:
        """The sets of asked paths that records of this layout have: optional paths or not; a list without elements."""
        if self.list_path:
            return [self.paths, (self.list_path,)]
        some = [p for p in self.paths if p in self.optional]
        return [tuple(p for p in self.paths if p not in left) for n in range(len(some) + 1) for left in combinations(some, n)]

    def turns(self, record: Column) -> Column:
        if self.list_path is None:
            pairs = F.array(*(F.struct(F.lit(r).alias("role"), F.try_variant_get(record, p, "string").alias("text")) for r, p in self.fields))
            return F.filter(pairs, lambda t: t["text"].isNotNull())
        items = F.coalesce(F.try_variant_get(record, self.list_path, f"array<struct<`{self.role}`:string,`{self.text}`:string>>"), F.array())
        def turn(x: Column) -> Column:
            role = F.coalesce(x[self.role], F.lit(""))
            for theirs, ours in self.roles:
                role = F.when(x[self.role] == theirs, ours).otherwise(role)
            return F.struct(role.alias("role"), F.coalesce(x[self.text], F.lit("")).alias("text"))

        return F.transform(items, turn)


MAPPINGS = (
    Mapping("messages", "$.messages", "role", "content"),
    Mapping("share", "$.conversations", "from", "value", roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping("dialog", "$.data.dialog", "speaker", "utterance"),
    Mapping("prompt", fields=(("system", "$.system_prompt"), ("user", "$.prompt"), ("assistant", "$.response")), optional=("$.system_prompt",)),
    Mapping("instruction", fields=(("system", "$.system"), ("user", "$.instruction"), ("assistant", "$.output")), optional=("$.system",)),
)


def field_paths(record: Column) -> Column:
    """The nested field names of a JSON value, types left out."""
    types = "(: |<)(?:VOID|BOOLEAN|TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL\\([0-9,]+\\)|STRING|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|VARIANT|UUID)(?=[,>]|$)"
    return F.regexp_replace(F.schema_of_variant(record), types, "$1")


def _has(record: Column, path: str) -> Column:
    at, elements, field = path.partition("[]")
    if not elements:
        return F.try_variant_get(record, path, "variant").isNotNull()
    items = F.coalesce(F.try_variant_get(record, at, "array<variant>"), F.array().cast("array<variant>"))
    return F.exists(items, lambda x: F.try_variant_get(x, f"${field}", "variant").isNotNull()) if field else F.size(items) > 0


def fingerprint(record: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """Hash of the asked paths that a record has."""
    asked = sorted({p for m in mappings for p in m.paths})
    return F.xxhash64(F.concat_ws(",", *(F.when(_has(record, p), F.lit(p)) for p in asked)))


def prints(m: Mapping) -> list[Column]:
    """The fingerprints of a mapping's records."""
    return [F.xxhash64(F.lit(",".join(sorted(x)))) for x in m.layouts]


def canonical(records: DataFrame, json_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records`` with ``layout``, ``status`` and ``turns`` (array of role and text)."""
    known = records.withColumn("__v", F.try_parse_json(F.col(json_col))).withColumn("__print", fingerprint(F.col("__v"), mappings))
    v, p = F.col("__v"), F.col("__print")
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for m in mappings:
        of_m = p.isin(*prints(m))
        layout = F.when(of_m, F.lit(m.name)).otherwise(layout)
        turns = F.when(of_m, m.turns(v)).otherwise(turns)
    status = F.when(v.isNull(), "not json").when(F.col("layout").isNull(), F.concat(F.lit("unknown "), field_paths(v))).otherwise("ok")
    return known.withColumn("layout", layout).withColumn("turns", turns).withColumn("status", status).drop("__v", "__print")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "\\\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "\\\\" + CONTROL, "$1")


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unrole(role: Column) -> Column:
    """Undo ``_role``: one left-to-right pass, so an escaped backslash before an n stays one."""
    parts = F.split(role, "\\\\\\\\", -1)  # between escaped backslashes
    return F.array_join(F.transform(parts, lambda x: unescape(F.replace(x, F.lit("\\n"), F.lit("\n")))), "\\")


def render(turns: Column) -> Column:
    """Struct of ``formatted`` and ``loss`` (array of start, length in code points)."""
    def pieces(t: Column) -> Column:
        head = F.concat(F.lit("### "), _role(t["role"]), F.lit(":\n"))
        return F.struct(head.alias("head"), escape(t["text"]).alias("body"), (t["role"] == LOSS_ROLE).alias("learn"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.char_length(x["head"])
        span = F.struct(start.alias("start"), F.char_length(x["body"]).cast("long").alias("length"))
        return F.struct((start + F.char_length(x["body"]) + len(END)).alias("at"), F.when(x["learn"], F.array_append(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return let(F.transform(turns, pieces), lambda ps: F.struct(
        F.array_join(F.transform(ps, lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate(ps, zero, step, lambda s: s["spans"]).alias("loss")))


def read_back(formatted: Column) -> Column:
    """The turns of a rendering."""
    def turn(x: Column) -> Column:
        cut = F.instr(x, "\n")
        return F.struct(_unrole(F.substr(x, F.lit(5), cut - 6)).alias("role"), unescape(F.substr(x, cut + 1)).alias("text"))

    chunks = F.split(formatted, "\\Q" + END + "\\E", -1)
    return F.transform(F.slice(chunks, 1, F.size(chunks) - 1), turn)


def masked(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def format_chats(records: DataFrame, json_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records`` with layout, status, ``formatted`` and ``loss``."""
    x = canonical(records, json_col, mappings)
    return x.withColumn("__r", render(F.coalesce("turns", F.array().cast(x.schema["turns"].dataType)))).select(
        *(c for c in x.columns if c != "turns"), F.col("__r.formatted").alias("formatted"), F.col("__r.loss").alias("loss"))


def records_of(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One JSON record per conversation from rows by turn, in the layout its turns allow: a
    prompt with its response, an instruction with a system text, or one of three list layouts by id."""
    row = F.struct(F.col(turn_col).alias("n"), F.coalesce(F.col(role_col), F.lit("")).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    conv = rows.groupBy(F.col(id_col).alias("conv_id")).agg(F.array_sort(F.collect_list(row)).alias("x"))
    roles = F.array_join(F.transform("x", lambda t: F.regexp_replace(t["r"], ",", "?")), ",")
    text = lambda i: F.get("x", F.lit(i))["t"]
    lists = {
        "messages": F.struct(F.transform("x", lambda t: F.struct(t["t"].alias("content"), t["r"].alias("role"))).alias("messages")),
        "share": F.struct(F.transform("x", lambda t: F.struct(
            F.when(t["r"] == "user", "human").when(t["r"] == "assistant", "gpt").otherwise(t["r"]).alias("from"), t["t"].alias("value"))).alias("conversations"), F.lit(0).alias("id")),
        "dialog": F.struct(F.struct(F.transform("x", lambda t: F.struct(t["r"].alias("speaker"), t["t"].alias("utterance"))).alias("dialog"), F.lit("").alias("topic")).alias("data")),
    }
    json = {k: F.to_json(v, {"ignoreNullFields": "false"}) for k, v in lists.items()}
    k = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    plain = ~F.exists("x", lambda t: t["r"].isin("human", "gpt"))  # names that layout gives another meaning
    record = (F.when((roles == "user,assistant") & (k == 0), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
              .when((roles == "system,user,assistant") & (k < 2), F.to_json(F.struct(text(1).alias("instruction"), text(2).alias("output"), text(0).alias("system"))))
              .when((k == 1) & plain, json["share"]).when(k == 2, json["dialog"]).otherwise(json["messages"]))
    return conv.select("conv_id", record.alias("record"))
