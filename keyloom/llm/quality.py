"""Quality rules: tokeniser fertility with rejection bands per language, and plain counts.

For every document a public vocabulary measures

* characters per token (fertility; low where the vocabulary knows nothing of the text),
* the share of byte-fallback tokens,
* the entropy of the document's token distribution, in bits, and relative to
  the greatest that its number of tokens allows.

Each language (column ``lang``) has a band of its own, fitted on labels by
:func:`fit`: limits of fertility, and the least entropy for the number of
tokens, as entropy grows with length.  Where a language has none, or the column
is missing, the dominant script's wide band stands.  A document is rejected
when it fails the base rules (too few words, too many words in repeated
windows) or leaves its band.

Words are encoded one by one (the vocabulary never merges across white space),
so each distinct word of a chunk is encoded once.

Nulls and edge cases: a null text counts as empty; an empty text has all counts
0, fails the base rules and is rejected; very long texts are measured whole;
repeated rows give repeated result rows; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .coder import PieceCoder


@dataclass(frozen=True)
class Band:
    """Limits of one language or script; a document is rejected outside them."""

    min_chars_per_token: float
    max_chars_per_token: float
    max_byte_share: float
    min_relative_entropy: float
    #: Least entropy in bits of a text of 2^KNOTS tokens, linear between them; empty for no such limit.
    min_entropy_bits: tuple[float, ...] = ()


KNOTS = tuple(range(5, 14))
#: A limit lies so many standard deviations under what quality 1 has; texts of up to 2^6 tokens are few and vary more.
DEVIATIONS = (10, 10, 5, 5, 5, 5, 5, 5, 5)
#: Limits by dominant script.  Bytes fall back more often where the vocabulary has few letters of a script.
BANDS = {
    "latin": Band(1.4, 9.0, 0.10, 0.35),
    "greek": Band(0.60, 6.0, 0.40, 0.35),
    "cyrillic": Band(0.80, 8.0, 0.20, 0.35),
    "cjk": Band(0.25, 4.0, 0.90, 0.35),
    "other": Band(0.20, 6.0, 0.95, 0.30),
    "none": Band(0.30, 9.0, 0.50, 0.20),
}

#: Limits by language, the outcome of :func:`fit` on documents and labels of sf0.1.
LANGUAGE_BANDS = {
    "de": Band(1.54, 3.65, 0.10, 0.35, (3.78, 4.27, 5.24, 5.62, 5.94, 6.21, 6.4, 6.48, 6.51)),
    "en": Band(1.33, 3.7, 0.10, 0.35, (3.72, 4.27, 5.29, 5.72, 6.08, 6.38, 6.6, 6.69, 6.73)),
    "es": Band(1.33, 3.12, 0.10, 0.35, (3.78, 4.28, 5.25, 5.64, 5.98, 6.26, 6.46, 6.55, 6.58)),
    "fr": Band(1.24, 3.29, 0.10, 0.35, (3.87, 4.31, 5.23, 5.59, 5.89, 6.14, 6.33, 6.41, 6.45)),
}


@dataclass(frozen=True)
class Rules:
    """Parameters; ``vocabulary`` is a sentencepiece model with byte fallback."""

    vocabulary: str = field(default_factory=lambda: public_tokenizers.path("piece_bpe_32k.model"))
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    bands: dict[str, Band] = field(default_factory=lambda: dict(BANDS))
    language_bands: dict[str, Band] = field(default_factory=lambda: dict(LANGUAGE_BANDS))
    #: Distinct words whose tokens a worker remembers before it starts afresh.
    remembered: int = 150_000


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, "
    "n_byte_tokens long, chars_per_token double, byte_share double, entropy_bits double, relative_entropy double, "
    "script string, base_failed boolean, reason string, kept boolean"
)

_SCRIPTS = ("latin", "greek", "cyrillic", "cjk", "other")


def _script_table() -> np.ndarray:
    """Script of a letter by its first byte; 255 for no letter, as for punctuation and symbols (E2) and for pictographs (:func:`scripts`)."""
    t = np.full(256, 255, np.uint8)
    t[65:91] = t[97:123] = 0
    t[0xC3:0xCA] = 0
    t[0xCD:0xD0] = 1
    t[0xD0:0xD4] = 2
    t[0xE3:0xEE] = 3
    t[0xD4:0xE1] = 4
    t[0xE1] = 4
    t[0xF0:0xF5] = 4
    return t


_SCRIPT = _script_table()


def scripts(data: np.ndarray) -> np.ndarray:
    """Script of each byte that begins a letter, 255 for all others; pictographs (F0 9F) are no letters."""
    if not len(data):
        return np.zeros(0, np.uint8)
    out = _SCRIPT[data]
    four = np.flatnonzero(data == 0xF0)
    out[four[data[np.minimum(four + 1, len(data) - 1)] == 0x9F]] = 255
    return out


_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(b"#*$%&|<>")] = 1


class Vocabulary:
    """Tokens of words under a sentencepiece model."""

    def __init__(self, path: str, most: int) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.is_byte = np.array([sp.is_byte(i) for i in range(self.size)], bool)
        self.coder = PieceCoder(lambda texts: sp.encode(texts, num_threads=1), most)

    def tokens(self, words: K.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in order, and how many each word has."""
        return self.coder.ids(words.data, words.start, words.end, hashes)


@lru_cache(maxsize=2)
def vocabulary(path: str, most: int) -> Vocabulary:
    """One a worker process, shared by its tasks."""
    return Vocabulary(path, most)


def _repeat_words(words: K.Words, hashes: np.ndarray, width: int) -> np.ndarray:
    """Per document, the words in ``width``-word windows that it holds twice or more."""
    n = len(words)
    rolled = K.rolling(K.prefix_sums(hashes), width)
    if not len(rolled):
        return np.zeros(words.chunk.n, np.int64)
    ok = np.flatnonzero(K.window_mask(words.bounds, width, len(rolled)))
    if not len(ok):
        return np.zeros(words.chunk.n, np.int64)
    keys = rolled[ok] ^ K.mix(words.doc[ok].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(ok), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return K.grouped_sum(K.covered(ok[twice], width, n).astype(np.int64), words.bounds)


def _dup_lines(chunk: K.Chunk, words: K.Words) -> np.ndarray:
    """Per document, the lines with a word that equal an earlier line."""
    if not len(chunk.data):
        return np.zeros(chunk.n, np.int64)
    breaks = np.flatnonzero(chunk.data == 10)
    doc_of = np.searchsorted(chunk.offsets, breaks, "right") - 1
    starts = np.concatenate((chunk.offsets[:-1], breaks + 1))
    ends = np.concatenate((chunk.offsets[1:], breaks))
    docs = np.concatenate((np.arange(chunk.n), doc_of))
    starts, order = np.sort(starts, kind="stable"), np.lexsort((starts, docs))
    docs = docs[order]
    starts = np.concatenate((chunk.offsets[:-1], breaks + 1))[order]
    ends = np.sort(ends, kind="stable")
    has = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    starts, ends, docs = starts[has], ends[has], docs[has]
    if not len(starts):
        return np.zeros(chunk.n, np.int64)
    h = K.stretch_hashes(chunk.data, starts, ends)
    keys = h ^ K.mix(docs.astype(np.uint64) + np.uint64(1))
    _, first = np.unique(keys, return_index=True)
    later = np.ones(len(keys), np.int64)
    later[first] = 0
    return np.bincount(docs, weights=later, minlength=chunk.n).astype(np.int64)


def _per_doc(flags: np.ndarray, chunk: K.Chunk) -> np.ndarray:
    return K.grouped_sum(flags.astype(np.int64), chunk.offsets)


def least_bits(bands: list[Band], n_tokens: np.ndarray) -> np.ndarray:
    """The least entropy that each text's band allows for its number of tokens."""
    out = np.zeros(len(bands), np.float64)
    at = np.log2(np.maximum(n_tokens, 1))
    for b in {id(b): b for b in bands if b.min_entropy_bits}.values():
        own = np.array([x is b for x in bands], bool)
        out[own] = np.interp(at[own], KNOTS, b.min_entropy_bits)
    return out


def measure(chunk: K.Chunk, rules: Rules, vocab: Vocabulary, langs: list[str | None] | None = None) -> dict[str, np.ndarray]:
    """All measures of one chunk, an array a column; ``langs`` are the texts' languages."""
    words = K.Words(chunk, K.SPACED)
    hashes = words.hashes()
    n_words = words.counts.astype(np.int64)
    lead = (chunk.data & 0xC0) != 0x80
    in_word = K.SPACED[chunk.data] if len(chunk.data) else np.zeros(0, bool)
    word_chars = _per_doc(lead & in_word, chunk)
    tokens, counts = vocab.tokens(words, hashes) if len(words) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    n_tokens = K.grouped_sum(counts, words.bounds)
    token_bounds = np.concatenate(([0], np.cumsum(n_tokens)))
    n_bytes = K.grouped_sum(vocab.is_byte[tokens].astype(np.int64), token_bounds)
    doc_of = np.repeat(np.arange(chunk.n), n_tokens)
    keys = np.sort(doc_of * vocab.size + tokens)
    edge = np.flatnonzero(np.diff(keys, prepend=-1))
    times = np.diff(np.append(edge, len(keys))).astype(np.float64)
    owner = keys[edge] // vocab.size if len(keys) else np.zeros(0, np.int64)
    total = np.maximum(n_tokens, 1).astype(np.float64)
    entropy = np.log2(total) - np.bincount(owner, weights=times * np.log2(times), minlength=chunk.n)[: chunk.n] / total
    entropy = np.where(n_tokens > 0, np.maximum(entropy, 0.0), 0.0)
    most = np.log2(np.minimum(np.maximum(n_tokens, 2), vocab.size))
    kinds = scripts(chunk.data)
    by_script = np.stack([_per_doc(kinds == k, chunk) for k in range(len(_SCRIPTS))])
    script = np.where(by_script.sum(0) > 0, np.array(_SCRIPTS)[by_script.argmax(0)], "none")
    out = {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": _per_doc(_SYMBOL[chunk.data] if len(chunk.data) else in_word, chunk),
        "n_dup_lines": _dup_lines(chunk, words),
        "n_repeat_words": _repeat_words(words, hashes, rules.window),
        "n_tokens": n_tokens,
        "n_byte_tokens": n_bytes,
        "chars_per_token": word_chars / total,
        "byte_share": n_bytes / total,
        "entropy_bits": entropy,
        "relative_entropy": entropy / most,
        "script": script,
    }
    base = (n_words < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_percent * n_words)
    bands = [rules.language_bands.get(lang) or rules.bands[s] for lang, s in zip(langs or [None] * chunk.n, script.tolist())]
    limit = {f: np.array([getattr(b, f) for b in bands], np.float64) for f in Band.__dataclass_fields__ if f != "min_entropy_bits"}
    reason = np.full(chunk.n, "", object)
    for name, failed in (
        ("entropy", (out["relative_entropy"] < limit["min_relative_entropy"]) | (entropy < least_bits(bands, n_tokens))),
        ("byte fallback", out["byte_share"] > limit["max_byte_share"]),
        ("fertility", (out["chars_per_token"] < limit["min_chars_per_token"]) | (out["chars_per_token"] > limit["max_chars_per_token"])),
        ("base", base),
    ):
        reason[failed] = name
    out |= {"base_failed": base, "reason": reason, "kept": reason == ""}
    return out


def measurer(rules: Rules) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: (doc_id, text, lang) to :data:`SCHEMA`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(rules.vocabulary, rules.remembered)
        for batch in batches:
            for chunk in K.chunks(batch.column("text")):
                got = measure(chunk, rules, vocab, batch.column("lang").slice(chunk.first, chunk.n).to_pylist())
                ids = batch.column("doc_id").slice(chunk.first, chunk.n)
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array(v) for v in got.values())], ["doc_id", *got])
        vocab.coder.forget()  # later stages run in the same worker

    return run


def quality(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Measures, reason and verdict of every row of ``docs`` (doc_id, text and, if known, lang); no shuffle."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.cast("string").alias("lang"))
    return text.mapInArrow(measurer(rules or Rules()), SCHEMA)


def kept_rows(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep; no shuffle."""
    rules = rules or Rules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(rules.vocabulary, rules.remembered)
        for batch in batches:
            for chunk in K.chunks(batch.column("text")):
                part = batch.slice(chunk.first, chunk.n)
                langs = part.column("lang").to_pylist() if "lang" in part.schema.names else None
                yield part.filter(pa.array(measure(chunk, rules, vocab, langs)["kept"]))
        vocab.coder.forget()  # later stages run in the same worker

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)


def fit(docs: DataFrame, labels: DataFrame, most: int = 10_000) -> dict[str, Band]:
    """Bands by language from labels (doc_id, quality) on at most ``most`` documents, those with the least hashes.

    Only quality 1 that passes the base rules counts.  The entropy limit is a
    parabola over the logarithm of the number of tokens, less
    :data:`DEVIATIONS` of the spread of all languages near that length; the
    fertility limits leave a quarter below the least and a half above the greatest.
    """
    sample = docs.join(labels.select("doc_id", "quality"), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    good = quality(sample.filter("quality = 1")).filter("not base_failed").select("doc_id", "n_tokens", "chars_per_token", "entropy_bits")
    rows = good.join(sample.select("doc_id", "lang"), "doc_id").filter("lang is not null").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()  # at most ``most``
    lang = np.array([r["lang"] for r in rows])
    size, chars, bits = (np.array([r[c] for r in rows], np.float64) for c in ("n_tokens", "chars_per_token", "entropy_bits"))
    size, knots = np.log2(size), np.array(KNOTS, np.float64)
    curves, rest = {}, np.zeros(len(rows))
    for k in sorted(set(lang.tolist())):
        own = lang == k
        if own.sum() < 50:  # too few for a curve; the script's band stands
            continue
        curves[k] = np.polyval(np.polyfit(np.minimum(size[own], 12), bits[own], 2), np.minimum(knots, 12))
        rest[own] = bits[own] - np.interp(size[own], knots, curves[k])
    spread = np.array([rest[near].std() if (near := abs(size - k) < 1).sum() > 20 else np.nan for k in knots])
    spread = np.interp(knots, knots[~np.isnan(spread)], spread[~np.isnan(spread)])
    return {
        k: Band(
            round(0.75 * chars[lang == k].min(), 2), round(1.5 * chars[lang == k].max(), 2), 0.10, 0.35,
            tuple(np.round(c - np.array(DEVIATIONS) * spread, 2).tolist()),
        )
        for k, c in curves.items()
    }
