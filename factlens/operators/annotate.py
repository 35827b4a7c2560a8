"""Default annotator hook: ``tokens`` and ``entities`` long tables.

tokens:   doc_id, tok_i, char_idx, text, pos, lemma, is_stop, is_alpha
entities: doc_id, start_tok, end_tok, label, text

Any annotator producing these two tables can be plugged into keywords / pronoun
resolution (e.g. a model run with ``mapInPandas``). This default one works document by document, without
a shuffle: tokens and the gaps between them come from JVM regular expressions; offsets (running sums over gaps and tokens), previous
tokens and runs of capitalised non-stop tokens (the entities, labelled by small rule tables) from vectorised steps over
all tokens of an Arrow batch. It is a deliberately simple stand-in for a linguistic model.
"""

from __future__ import annotations

import calendar
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.functions.text import WS
from factlens.operators.retrieve import bounded_batches

_WS_CHARS = WS[1:-1]
TOKEN_RE = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_WS_CHARS}]"

# Pronoun classes of the referent rule (he/she -> PERSON;
# it -> ORG, GPE, PERSON; they -> NORP, GPE, ORG, PERSON) and possessive forms.
PRONOUN_CLASSES = {
    "he": ("PERSON",), "him": ("PERSON",), "his": ("PERSON",), "himself": ("PERSON",),
    "she": ("PERSON",), "her": ("PERSON",), "hers": ("PERSON",), "herself": ("PERSON",),
    "it": ("ORG", "GPE", "PERSON"), "its": ("ORG", "GPE", "PERSON"), "itself": ("ORG", "GPE", "PERSON"),
    "they": ("NORP", "GPE", "ORG", "PERSON"), "them": ("NORP", "GPE", "ORG", "PERSON"),
    "their": ("NORP", "GPE", "ORG", "PERSON"), "theirs": ("NORP", "GPE", "ORG", "PERSON"),
    "themselves": ("NORP", "GPE", "ORG", "PERSON"),
}
POSSESSIVE_PRONOUNS = ("his", "her", "its", "their")

# Our own short English function-word list for the default annotator's is_stop.
STOP_WORDS = tuple("""a an the and or but if then else when while of at by for with about against between into
through during before after above below to from up down in out on off over under again further once here there
all any both each few more most other some such no nor not only own same so than too very can will just should now
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it
its itself they them their theirs themselves what which who whom this that these those am is are was were be been
being have has had having do does did doing would could might must shall may also""".split())

# Our own rule tables for entity labels.
ORG_SUFFIXES = ("inc", "corp", "party", "ministry", "council", "university", "company", "bank",
                "association", "agency", "committee", "senate", "congress", "court", "union", "news")
VERB_ENDINGS = ("ing", "ed")
NORP_ENDINGS = ("ans", "ese", "ish", "ians")
GPE_NAMES = ("america", "united states", "usa", "china", "russia", "ukraine", "france", "germany", "spain",
             "italy", "india", "japan", "canada", "mexico", "brazil", "israel", "iran", "texas", "california",
             "florida", "new york", "washington", "london", "paris", "berlin", "madrid", "moscow", "beijing",
             "europe", "africa", "asia")


def default_exclusions() -> list[str]:
    """Rule-built default exclusion words: weekday and month names. Pass a fuller
    list (a column or a DataFrame of words) to ``extract_keywords`` when needed."""
    return [d.lower() for d in calendar.day_name] + [m.lower() for m in calendar.month_name if m]


TOKENS = "array<struct<tok_i:int,char_idx:int,text:string,pos:string,lemma:string,is_stop:boolean,is_alpha:boolean>>"
ENTITIES = "array<struct<start_tok:int,end_tok:int,label:string,text:string>>"


def _is_in(values: pa.Array, words) -> np.ndarray:
    return pc.is_in(values, value_set=pa.array(list(words), pa.string())).to_numpy(zero_copy_only=False)


SLICE_TOKENS = 1 << 16  # tokens annotated at once (or one longer document)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``SLICE_TOKENS`` tokens (column 1)."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE_TOKENS, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _annotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tokens, lengths of the gaps before them) to (id, toks, ents); all tokens of a slice at once."""
    tok_names, ent_names = (re.findall(r"(\w+):", t) for t in (TOKENS, ENTITIES))
    for batch in _slices(batches):
        lists, gap_lists = (c if c.null_count == 0 else pc.fill_null(c, pa.scalar([], c.type)) for c in (batch.column(1), batch.column(2)))
        ends = lists.offsets.to_numpy()
        text = lists.values.slice(int(ends[0]), int(ends[-1] - ends[0])).cast(pa.string())
        ends = ends - ends[0]
        n, counts = len(text), np.diff(ends)
        doc = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(n) - np.repeat(ends[:-1], counts)
        gap_ends = gap_lists.offsets.to_numpy()
        gaps = gap_lists.values.slice(int(gap_ends[0]), int(gap_ends[-1] - gap_ends[0])).to_numpy(zero_copy_only=False)[np.repeat(gap_ends[:-1] - gap_ends[0], counts) + at]  # one more gap than tokens
        length = pc.utf8_length(text).to_numpy(zero_copy_only=False)
        upto = np.cumsum(gaps + length)
        before = np.concatenate([[0], upto])[np.repeat(ends[:-1], counts)]
        low = pc.utf8_lower(text)
        first = pc.utf8_slice_codeunits(text, 0, 1)
        title = pc.and_(pc.equal(first, pc.utf8_upper(first)), pc.not_equal(first, pc.utf8_lower(first))).to_numpy(zero_copy_only=False)
        match = lambda values, rule: pc.match_substring_regex(values, rule).to_numpy(zero_copy_only=False)
        alpha, stop = match(text, r"^\p{L}+$"), _is_in(low, STOP_WORDS)
        ends_sentence = _is_in(text, (".", "!", "?"))
        prev_open = np.concatenate([[False], ~ends_sentence[:-1]]) & (at > 0) if n else np.zeros(0, bool)
        verb = alpha & np.logical_or.reduce([pc.ends_with(low, s).to_numpy(zero_copy_only=False) for s in VERB_ENDINGS])
        pos = np.select([_is_in(low, PRONOUN_CLASSES), match(text, "^[0-9]+$"), ~match(text, r"[\p{L}\p{N}]"), title & ~stop & prev_open, verb],
                        ["PRON", "NUM", "PUNCT", "PROPN", "VERB"], "NOUN")
        toks = pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array((upto - length - before).astype(np.int32)), text, pa.array(pos.astype(object), pa.string()), low,
                                           pa.array(stop), pa.array(alpha)], names=tok_names)
        cap = title & alpha & ~stop
        new = cap & np.concatenate([[True], ~cap[:-1] | (doc[1:] != doc[:-1])]) if n else cap
        start = np.flatnonzero(new)
        run = np.cumsum(new)[cap] - 1
        size = np.bincount(run, minlength=len(start))
        named = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), text.filter(pa.array(cap)))
        name = pc.binary_join(named, " ")
        low_name = pc.utf8_lower(name)
        last = low.take(pa.array(start + size - 1))
        norp = np.logical_or.reduce([pc.ends_with(low_name, s).to_numpy(zero_copy_only=False) for s in NORP_ENDINGS]) & (size == 1)
        label = np.select([_is_in(low_name, GPE_NAMES), _is_in(last, ORG_SUFFIXES), norp], ["GPE", "ORG", "NORP"], "PERSON")
        ents = pa.StructArray.from_arrays([pa.array(at[start].astype(np.int32)), pa.array((at[start] + size).astype(np.int32)), pa.array(label.astype(object), pa.string()), name],
                                          names=ent_names)
        ent_ends = np.searchsorted(doc[start], np.arange(len(counts) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), toks), pa.ListArray.from_arrays(pa.array(ent_ends), ents)],
                                         names=["doc_id", "toks", "ents"])


def annotate_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, toks, ents`` (the rows of both tables as lists, in order). One scan, no shuffle."""
    bounded_batches(docs.sparkSession)
    toks = F.regexp_extract_all(F.col(text_col), F.lit(TOKEN_RE), 0)
    gaps = F.transform(F.split(F.col(text_col), TOKEN_RE, -1), lambda g: F.char_length(g))
    d = docs.select(F.col(id_col).alias("doc_id"), toks.alias("t"), gaps.alias("g"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(_annotations, f"doc_id {kind}, toks {TOKENS}, ents {ENTITIES}")


def tokens_of(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.explode("toks").alias("t")).select("doc_id", "t.*")


def entities_of(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.explode("ents").alias("e")).select("doc_id", "e.*")


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    rows = annotate_rows(docs, id_col, text_col)
    return tokens_of(rows), entities_of(rows)
