"""Texts that stop before their file ended: vocabulary tries and length evidence.

Two tries are built from the whole corpus, leaving out a last line without line end: of the
letters of its words, and of the tokens of its lines (identifiers, numbers and plain words
as classes). Against them the last word and the last line of a text are known as a whole, an
unknown proper prefix of known ones, or neither. Beside this stand the last line's last and
first token and indentation, how many kinds of brackets are open, and whether the text ends
in a line end.

What each of these tells is learned from the corpus. Texts that end in a line end show how
whole files end (their line end taken off). The same texts cut at a place drawn by a hash
show how texts end that were cut within a line, and cut after a line drawn by it, how those
end that were cut between lines. A text's end has a probability under each of the three; the
odds of the two kinds of cuts together against the whole file make its score, with the
length evidence: the number of different texts of exactly this length over that of the
lengths below, where hardly any text of the source is longer. Elsewhere the share of cut
texts, estimated by expectation maximisation over all scores, stands in its place. A text is
cut if that is more likely than not. Texts that were cut right after a line end are counted
among the whole ones at first; each of three rounds takes out as many as the one before
expects. All frequencies count different texts, so copies weigh once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectralmill.functions.cleaning import clean_source
from spectralmill.llm.words import slices
from spectralmill.operators.skew import HOT_KEYS, join_margins
from spectralmill.scratch import Scratch

_NAMES = re.compile(r"[A-Za-z]+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[A-Z]")
_TOKENS = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|\S")
_BREAK = re.compile(r"\r\n|\n|\r")
HALF = "\N{REPLACEMENT CHARACTER}"  # what decoders put for half a character
SPAN = 20  # lengths below a pile that it is compared with
WEIGHT = 4.0  # texts that the last token of a line counts for, beside those of the line's whole form
FEATURES = (
    "kind string, doc_id {kind}, source string, chars bigint, bytes bigint, whole_text bigint, line_end boolean, broken boolean, "
    "word string, line bigint, open int, form string, last string, token string, node bigint, complete boolean, low bigint, high bigint"
)
COLUMNS = [c.split()[0] for c in FEATURES.split(", ")]
TYPES = [pa.string(), None, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), seed) - (1 << 63)


def line_tokens(line: str) -> list[str]:
    """Classes of a line's tokens, runs of one class once: its first plain word as it is, other plain words w, capitalised ones W, other names I, numbers 9, and signs."""
    out: list[str] = []
    for token in _TOKENS.findall(line):
        first = token[0]
        if first.isascii() and (first.isalpha() or first == "_"):
            plain = token.isalpha()
            kind = (token if not out else "w") if plain and token.islower() else "W" if plain and token[1:].islower() or len(token) == 1 and plain else "I"
        else:
            kind = "9" if first in "0123456789" else token
        if not (out and out[-1] == kind and kind in ("w", "W", "I", "9")):
            out.append(kind)
    return out


def nodes_of(tokens: list[str]) -> list[int]:
    """The trie nodes on the way to a line: for each of its beginnings a 64-bit hash of all tokens so far."""
    out, node = [], 0
    for token in tokens:
        node = xxhash.xxh64_intdigest(token.encode("utf-8", "replace"), node)
        out.append(node)
    return [n - (1 << 63) for n in out]


def final_word(text: str) -> str | None:
    """The last part of the name or word that the text ends in, in lower case; null if it ends in another sign."""
    end = len(text)
    while end and text[end - 1].isascii() and text[end - 1].isalpha():
        end -= 1
    return _PARTS.findall(text[end:])[-1].lower() if end < len(text) else None


def ending(text: str) -> tuple:
    """(word, line, open, form, last) of the end of a text, a line end at its end taken off."""
    body = text.rstrip("\r\n")
    line = body[max(body.rfind("\n"), body.rfind("\r")) + 1 :]
    tokens = line_tokens(line)
    nodes = nodes_of(tokens)
    opened = sum(body.count(a) > body.count(b) for a, b in ("()", "[]", "{}"))
    indent = min(2, (len(line) - len(line.lstrip()) + 3) // 4)
    first, last = (tokens[0], tokens[-1]) if tokens else ("", "")
    last = "w" if len(tokens) == 1 and last.isalpha() and last.islower() else last
    return final_word(body), nodes[-1] if nodes else 0, opened, f"{indent} {first}", last


def _batch(rows: list[tuple], doc_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(c, t or doc_type) for c, t in zip(columns, TYPES)], names=COLUMNS)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kinds text (a text's end), cut and stop (the end of a whole text that was cut at a drawn place within a line, or after a drawn line), word and line (the tries' entries)."""
    for batch in (whole.slice(begin, end - begin) for whole in batches for begin, end in slices(whole.column("text"), 16 << 20)):
        doc_type, rows = batch.column("doc_id").type, []
        names: dict[str, list[int]] = {}  # of each name the least and greatest hash of the texts that have it
        lines: dict[str, list[int]] = {}
        for doc, source, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source", "text"))):
            data = text.encode("utf-8", "replace")
            own = xxhash.xxh64_intdigest(data) - (1 << 63)
            ended = text.endswith(("\n", "\r"))
            rows.append(("text", doc, source, len(text), len(data), own, ended, text.endswith(HALF), *ending(text), None, None, None, None, None))
            if ended and len(text) > 1:
                cut = text[: 1 + (own & ((1 << 62) - 1)) % (len(text) - 1)]
                at = 1 + (own & ((1 << 62) - 1)) % (len(text) - 1)
                if text[at - 1] not in "\r\n" and text[at] not in "\r\n":
                    rows.append(("cut", None, None, None, None, own, False, False, *ending(text[:at]), None, None, None, None, None))
                stops = [m.start() for m in _BREAK.finditer(text)]
                rows.append(("stop", None, None, None, None, own, False, False, *ending(text[: stops[own % len(stops)]]), None, None, None, None, None))
            before = text if ended else text[: max(text.rfind("\n"), text.rfind("\r")) + 1]
            for seen, found in ((names, set(_NAMES.findall(before))), (lines, set(_BREAK.split(before)))):
                for x in found:
                    held = seen.get(x)
                    if held is None:
                        seen[x] = [own, own]
                    elif own < held[0]:
                        held[0] = own
                    elif own > held[1]:
                        held[1] = own
        yield _batch(rows, doc_type)
        words: dict[str, list[int]] = {}
        for name, (low, high) in names.items():
            for part in _PARTS.findall(name):
                held = words.setdefault(part.lower(), [low, high])
                held[0], held[1] = min(held[0], low), max(held[1], high)
        nothing = (None,) * 12
        yield _batch([("word", *nothing, word, None, None, low, high) for word, (low, high) in words.items()], doc_type)
        nodes: dict[tuple[int, bool], list[int]] = {}
        forms: dict[tuple[str, ...], list[int]] = {}
        for line, (low, high) in lines.items():
            held = forms.setdefault(tuple(line_tokens(line)), [low, high])
            held[0], held[1] = min(held[0], low), max(held[1], high)
        for form, (low, high) in forms.items():
            chain = nodes_of(list(form))
            for at, node in enumerate(chain):
                held = nodes.setdefault((node, at == len(chain) - 1), [low, high])
                held[0], held[1] = min(held[0], low), max(held[1], high)
        yield _batch([("line", *nothing, None, node, complete, low, high) for (node, complete), (low, high) in nodes.items()], doc_type)


def vocabulary_trie(vocabulary: DataFrame, wanted: DataFrame) -> DataFrame:
    """(prefix, words): nodes of the trie over ``vocabulary`` (word) that ``wanted`` (prefix) asks for, with the number of words below each."""
    nodes = vocabulary.select("word", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), F.lit(1), i))).alias("prefix"))
    return nodes.where(F.length("word") > 1).join(wanted.select("prefix").distinct(), "prefix", "left_semi").groupBy("prefix").agg(F.count("*").alias("words"))


def _limits(texts: DataFrame, measure: str, slack: int, least: int) -> DataFrame:
    """(source, measure, weight): lengths at which different texts of a source pile up, with hardly any longer text.

    A pile holds ``least`` different texts, most of them of its greatest length, and half of all
    that are as long or longer. ``slack`` is by how much a cut may stop short so as not to
    split a character. weight is the logarithm of the number of texts of this length over the
    mean number of texts of the ``SPAN`` lengths below the pile, half a text added to their sum.
    """
    each = texts.groupBy("source", F.col(measure).alias("length")).agg(F.count("*").alias("texts"))
    down, up = W.partitionBy("source").orderBy(F.desc("length")), W.partitionBy("source").orderBy("length")  # one row for each length
    longer = F.coalesce(F.sum("texts").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    below = (F.coalesce(F.sum("texts").over(up.rangeBetween(-slack - SPAN, -slack - 1)), F.lit(0)) + 0.5) / SPAN
    piles = each.select("source", "length", "texts", longer.alias("longer"), F.sum("texts").over(up.rangeBetween(-slack, 0)).alias("pile"), below.alias("below"))
    limits = piles.where((F.col("pile") >= least) & (F.col("pile") >= F.col("longer")) & (F.col("texts") * 2 >= F.col("pile")))
    reached = limits.select("source", "below", F.explode(F.sequence(F.col("length") - slack, F.col("length"))).alias("length")).join(each, ["source", "length"])
    weighed = reached.select("source", F.col("length").alias(measure), F.ln(F.col("texts") / F.col("below")).alias("weight"))
    return weighed.where("weight > 0").groupBy("source", measure).agg(F.max("weight").alias("weight"))


KINDS = ("cut", "stop", "text")


def _logs(counts: DataFrame, keys: list[str], within: list[str], into: str) -> DataFrame:
    """(keys, into: struct): logarithm of the frequency of ``keys`` among samples of each kind that are equal in ``within``.

    ``counts`` has keys and the number of samples of each kind. Where samples are few, the
    frequency is drawn to that of all kinds together, which then tells nothing.
    """
    of_key = counts.groupBy(*keys).agg(*(F.sum(k).alias(k) for k in KINDS))
    totals = of_key.groupBy(*within).agg(*(F.sum(k).alias(f"_t{k}") for k in KINDS))
    joined = of_key.join(totals, within)
    share = sum(F.col(k) for k in KINDS) / sum(F.col(f"_t{k}") for k in KINDS) * WEIGHT
    return joined.select(*keys, F.struct(*(F.ln((F.col(k) + share) / (F.col(f"_t{k}") + WEIGHT)).alias(k) for k in KINDS)).alias(into))


def _plain(counts: DataFrame, keys: list[str], totals: dict[str, float], into: str) -> DataFrame:
    """(keys, into: struct): logarithm of the frequency of ``keys`` among all samples of each kind, half a sample added to each."""
    of_key = counts.groupBy(*keys).agg(*(F.sum(k).alias(k) for k in KINDS))
    return of_key.select(*keys, F.struct(*(F.ln((F.col(k) + 0.5) / (totals[k] + 1)).alias(k) for k in KINDS)).alias(into))


def _word_logs(counts: DataFrame) -> DataFrame:
    """(_line, _word, _known: struct): logarithm of the frequency of each state of the last word among samples that end in a word and such a line.

    Lines are complete in whole texts as in those cut between lines, so both are counted together.
    """
    of_key = counts.where("_word <> 'none'").groupBy("_line", "_word").agg(F.sum("cut").alias("c"), (F.sum("stop") + F.sum("text")).alias("b"))
    joined = of_key.join(of_key.groupBy("_line").agg(F.sum("c").alias("tc"), F.sum("b").alias("tb")), "_line")
    cut, both = (F.ln((F.col(n) + 0.5) / (F.col(f"t{n}") + 1)) for n in ("c", "b"))
    return joined.select("_line", "_word", F.struct(cut.alias("cut"), both.alias("stop"), both.alias("text")).alias("_known"))


def _shares(scores: DataFrame, rounds: int = 50) -> dict[str, float]:
    """Shares of texts cut within and between lines, by expectation maximisation over the histogram of their odds (at most 121 * 121 rows); ``scores`` has cut, stop and n."""
    near = lambda c: (F.round(F.least(F.lit(30.0), F.greatest(F.lit(-30.0), F.col(c))) * 2) / 2).alias(c)
    rows = scores.groupBy(near("cut"), near("stop")).agg(F.sum("n").alias("n")).collect()
    total, shares = sum(r["n"] for r in rows), {"cut": 0.03, "stop": 0.01}
    for _ in range(rounds if total else 0):
        found = dict.fromkeys(shares, 0.0)
        for r in rows:
            odds = {k: v * math.exp(r[k]) for k, v in shares.items()}
            whole = sum(odds.values()) + 1 - sum(shares.values())
            for k in found:
                found[k] += r["n"] * odds[k] / whole
        shares = {k: min(0.25, max(v / total, 0.5 / (total + 1))) for k, v in found.items()}
    return shares


ENDS = ["_word", "_line", "open", "form", "last"]


def _score(forms: DataFrame, counts: DataFrame, held: dict[str, int], ended: float, spoiled: float) -> DataFrame:
    """``forms`` (ENDS, line_end, n) with cut and stop, the logarithms of how much likelier such an end is for texts cut within and between lines, and ending, whether its last line says so.

    ``counts`` has the samples of each kind by ENDS, ``held`` their numbers; ``spoiled`` is
    the expected number of cut texts among the whole ones.
    """
    totals = {"cut": held["cut"], "stop": held["stop"], "text": max(0.0, held["text"] - spoiled)}
    if not totals["cut"] or not totals["text"]:
        return forms.withColumns({"cut": F.lit(0.0), "stop": F.lit(0.0), "ending": F.lit(False)})
    counts = counts.withColumn("text", F.greatest(F.lit(0.0), F.col("text") - F.col("stop") * (spoiled / max(1, held["stop"]))))
    forms, counts = (x.withColumn("_bare", F.col("_word") == "none") for x in (forms, counts))
    parts = [(_plain(counts, ["_line", "_bare"], totals, "_trie"), ["_line", "_bare"], 0.5), (_word_logs(counts), ["_line", "_word"], None), (_plain(counts, ["last"], totals, "_last"), ["last"], 0.5)]
    parts += [(_logs(counts, ["last", "open"], ["last"], "_open"), ["last", "open"], None), (_logs(counts, ["last", "open", "form"], ["last", "open"], "_form"), ["last", "open", "form"], None)]
    for part, keys, missing in parts:
        name = part.columns[-1]
        none = F.struct(*(F.lit(math.log(missing / (totals[k] + 1)) if missing else 0.0).alias(k) for k in KINDS))
        forms = forms.join(part, keys, "left").withColumn(name, F.coalesce(name, none))
    # a line end follows whole texts as often as all texts, no cut within a line, and half of those between lines
    follows = {"text": ended, "cut": 0.5 / (totals["cut"] + 1), "stop": 0.5}
    line = {k: F.col(f"_last.{k}") + F.col(f"_open.{k}") + F.col(f"_form.{k}") for k in KINDS}
    chance = {k: line[k] + F.col(f"_trie.{k}") + F.col(f"_known.{k}") + F.when(F.col("line_end"), math.log(follows[k])).otherwise(math.log(1 - follows[k])) for k in KINDS}
    ending = F.greatest(line["cut"], line["stop"]) > line["text"]
    return forms.select(*ENDS, "line_end", "n", *((chance[k] - chance["text"]).alias(k) for k in ("cut", "stop")), ending.alias("ending"))


def find_truncated(documents: DataFrame, least_pile: int = 3) -> DataFrame:
    """(doc_id, source, signs, score, truncated), one row for each text that is not null or empty.

    ``documents`` has doc_id, text and source. score is the logarithm of the odds that the
    text is cut. signs tells what speaks for it: word and line (the last one is an unknown
    proper prefix in its trie), length (a limit of its source, see ``_limits``), ending (the
    form of the last line is that of cut texts), broken (half a character at the end, which
    decides alone), copy (an equal text has the length). Copies have the same end, so all are
    judged by the greatest length evidence among them. Sources are cleaned; texts without
    source are a source of their own. Words and lines of one text only are not in the tries.
    Repeated rows each get their row; an empty table gives an empty result.
    """
    scratch = Scratch(documents.sparkSession, "truncation")
    kind = dict(documents.dtypes)["doc_id"]
    source = documents.select("doc_id", clean_source(F.col("source")).alias("source"), "text").where("length(text) > 0")
    every = scratch.save(source.mapInArrow(_features, FEATURES.format(kind=kind)))
    ends = every.where("kind not in ('word', 'line')").drop("token", "node", "complete", "low", "high")
    several = F.min("low") < F.max("high")  # held by two different texts at least
    words = ends.where("word is not null").groupBy("word").agg(F.count("*").alias("_n"))
    vocabulary = scratch.save(every.where("kind = 'word'").groupBy(F.col("token").alias("word")).agg(several.alias("known")).where("known").select("word"))
    unknown = scratch.save(words.join(vocabulary, "word", "left_anti"))
    beginnings = vocabulary_trie(vocabulary, unknown.select(F.col("word").alias("prefix"))).select(F.col("prefix").alias("word"), F.lit(True).alias("_begins"))
    strange = unknown.join(beginnings, "word", "left").select("word", "_n", F.when(F.col("_begins"), "prefix").otherwise("other").alias("_word"))
    asked = ends.groupBy(F.col("line").alias("node")).agg(F.count("*").alias("_n"))
    nodes = every.where("kind = 'line'").join(asked.select("node"), "node", "left_semi").groupBy("node", "complete").agg(several.alias("known")).where("known")
    lines = nodes.groupBy("node").agg(F.max("complete").alias("_whole")).join(asked, "node").select(F.col("node").alias("line"), F.when(F.col("_whole"), "known").otherwise("prefix").alias("_line"), "_n")
    # a last word is known unless it is in ``strange``; a last line is neither known nor a prefix unless it is in ``lines``
    frequent = words.where(F.col("_n") * HOT_KEYS > ends.agg(F.count("*")).scalar()).join(strange.select("word"), "word", "left_anti").select("word", "_n", F.lit("known").alias("_word"))
    told = join_margins(ends, strange.unionByName(frequent), "word", "_n", "left").drop("_n")
    told = join_margins(told, lines, "line", "_n", "left").drop("_n")
    told = told.withColumns({"_word": F.when(F.col("word").isNull(), "none").otherwise(F.coalesce("_word", F.lit("known"))), "_line": F.coalesce("_line", F.lit("other"))})
    told = scratch.save(told.drop("word", "line").withColumn("_source", F.coalesce("source", F.lit(""))))
    texts = told.where("kind = 'text'")

    samples = told.where("kind <> 'text' or line_end").dropDuplicates(["kind", "whole_text"])
    counts = scratch.save(samples.groupBy(*ENDS).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in KINDS)))
    held = {k: v or 0 for k, v in counts.agg(*(F.sum(k).alias(k) for k in KINDS)).first().asDict().items()}
    different = scratch.save(texts.dropDuplicates(["whole_text"]).groupBy(*ENDS, "line_end").agg(F.count("*").alias("n")))
    number = different.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("line_end"), F.col("n")).otherwise(0)).alias("e")).first()
    ended = ((number["e"] or 0) + 0.5) / ((number["n"] or 0) + 1)
    spoiled = 0.0
    for _ in range(3):
        scored = scratch.save(_score(different, counts, held, ended, spoiled))
        shares = _shares(scored)
        spoiled = shares["stop"] * (number["n"] or 0) / 2  # half of them end in a line end
    share = sum(shares.values())
    prior = math.log(share / (1 - share))
    cut, stop = (F.col(k) + math.log(v / share) for k, v in shares.items())
    most = F.greatest(cut, stop)
    scored = scored.withColumn("own", most + F.log1p(F.exp(F.least(cut, stop) - most)))

    key = F.xxhash64(*ENDS, "line_end")
    of_end = scored.withColumn("_end", key).groupBy("_end").agg(F.max("own").alias("own"), F.max("ending").alias("ending"))
    rows = texts.groupBy(key.alias("_end")).agg(F.count("*").alias("_n"))
    judged = join_margins(texts.withColumn("_end", key), of_end.join(rows, "_end"), "_end", "_n").drop("_n")
    once = scratch.save(texts.select("_source", "chars", "bytes", "whole_text").dropDuplicates(["_source", "whole_text"]))
    for measure, slack in (("chars", 0), ("bytes", 3)):
        limit = _limits(once.withColumnRenamed("_source", "source"), measure, slack, least_pile)
        limit = limit.select(F.struct(F.col("source").alias("_source"), measure).alias("_k"), F.col("weight").alias(f"_by_{measure}"))
        of_limit = texts.groupBy(F.struct("_source", measure).alias("_k")).agg(F.count("*").alias("_n"))
        judged = join_margins(judged.withColumn("_k", F.struct("_source", measure)), of_limit.join(limit, "_k"), "_k", "_n", "left").drop("_k", "_n")
    length = F.greatest(F.coalesce("_by_chars", F.lit(0.0)), F.coalesce("_by_bytes", F.lit(0.0)))
    judged = scratch.save(judged.select("doc_id", "source", "whole_text", "broken", "_word", "_line", "own", "ending", length.alias("_length")))
    best = judged.groupBy("whole_text").agg(F.max("_length").alias("_best"), F.count("*").alias("_n")).where("_best > 0")
    judged = join_margins(judged, best, "whole_text", "_n", "left").withColumn("_best", F.coalesce("_best", F.lit(0.0)))
    judged = judged.withColumn("score", F.col("own") + F.greatest(F.lit(prior), F.when(F.col("_best") > 0, F.col("_best"))))
    truncated = F.col("broken") | (F.col("score") > 0)
    signs = F.array_compact(F.array(
        F.when(F.col("_word") == "prefix", "word"), F.when(F.col("_line") == "prefix", "line"), F.when(F.col("_length") > 0, "length"),
        F.when(F.col("ending"), "ending"), F.when(F.col("broken"), "broken"), F.when((F.col("_best") > 0) & (F.col("_length") == 0), "copy"),
    ))
    return judged.select("doc_id", "source", F.when(truncated, signs).otherwise(F.array().cast("array<string>")).alias("signs"), F.round("score", 3).alias("score"), truncated.alias("truncated"))


def truncation_by_source(found: DataFrame) -> DataFrame:
    """(source, texts, truncated, share) from the result of ``find_truncated``."""
    return found.groupBy("source").agg(F.count("*").alias("texts"), F.count_if("truncated").alias("truncated")).withColumn("share", F.col("truncated") / F.col("texts"))
