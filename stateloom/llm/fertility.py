"""Quality rules with tokeniser fertility.

Each document gets base counts (words, symbols, repeated lines, repeated word windows)
and three measures under public vocabularies: characters per token, the share of tokens
that are byte fallbacks, and the entropy of the token distribution in bits.  A document
is kept if its base rules pass and its measures lie inside the band of its language, or
of its script where the language is unknown.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._arrays import window_hashes
from ._worker import held

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
#: Words kept in each of two generations, and the longest word kept, in one Python worker.
MEMO_WORDS, MEMO_CHARS = 120_000, 48
#: Stands for a rank token among piece numbers.
NO_PIECE = 0xFFFF


class Band(NamedTuple):
    """Inclusive limits; chars_per_token is under the rank vocabulary, its lower limit that of a long text."""

    min_chars_per_token: float
    max_chars_per_token: float
    max_byte_share: float
    min_entropy: float


#: Three standard deviations of characters per token, which is about 1 for one token of prose.
SAMPLING = 3.0


def lower_limit(band: Band, tokens: int) -> float:
    """The band's least characters per token, less the sampling error of a text of so many tokens."""
    return band.min_chars_per_token - SAMPLING / math.sqrt(tokens)


#: By language, then by script for other languages; the last is for no letters at all.  The
#: languages' lower limits are those of ``fit_lower_limits`` on 500 labelled rows each; no
#: prose reaches the upper limits, which are for texts of a few very long known tokens; the
#: scripts have no labelled rows, and floors that only broken text falls below.
BANDS: Mapping[str, Band] = {
    "en": Band(2.20, 9.0, 0.10, 4.5),
    "de": Band(2.28, 9.0, 0.10, 4.5),
    "fr": Band(2.01, 9.0, 0.10, 4.5),
    "es": Band(2.03, 9.0, 0.10, 4.5),
    "LATIN": Band(1.60, 9.0, 0.25, 4.0),
    "GREEK": Band(0.60, 9.0, 0.50, 3.5),
    "CYRILLIC": Band(0.80, 9.0, 0.50, 3.5),
    "HAN": Band(0.30, 6.0, 0.80, 3.5),
    "OTHER": Band(0.20, 9.0, 0.95, 3.5),
    "NONE": Band(1.00, 9.0, 0.50, 4.0),
}
#: First and last code points of the scripts that have a band of their own (fixed values).
SCRIPTS = {
    "LATIN": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)),
    "GREEK": ((0x370, 0x3FF),),
    "CYRILLIC": ((0x400, 0x52F),),
    "HAN": ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7A3)),
}
#: Bands that only a text's script selects, never a language of that name.
SCRIPT_BANDS = {*SCRIPTS, "OTHER", "NONE"}
_RANGES = {k: re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in v) + "]") for k, v in SCRIPTS.items()}
_OTHER = re.compile(r"[^\W\d_]")


def script_of(text: str) -> str:
    """The script with the most letters; OTHER or NONE if no listed script has any."""
    counts = {k: sum(1 for _ in p.finditer(text)) for k, p in _RANGES.items()}
    best = max(counts, key=counts.get)
    if counts[best]:
        return best
    return "OTHER" if _OTHER.search(text) else "NONE"


def _packed(pieces: list[int], tokens: int) -> bytes:
    """16-bit piece numbers, then as many times NO_PIECE as there are rank tokens."""
    return np.array(pieces, np.uint16).tobytes() + b"\xff\xff" * tokens


class Vocabularies:
    """Pieces of single words under a byte-fallback model, and counts under a rank file."""

    def __init__(self, model_path: str, ranks_path: str, pattern: str):
        import sentencepiece
        import tiktoken

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        is_byte = [self.model.is_byte(i) for i in range(self.model.get_piece_size())]
        self.is_byte = np.array(is_byte)
        if len(is_byte) > NO_PIECE:
            raise ValueError("a model of fewer pieces is needed")
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        #: Whether a token begins a word that stands after a space.
        self.opens_piece = np.array([self.model.id_to_piece(i).startswith("▁") for i in range(len(is_byte))])
        self.opens_token = np.zeros(max(ranks.values()) + 1, bool)
        self.opens_token[[i for t, i in ranks.items() if t.startswith(b" ")]] = True
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encoded(self, words: list[str]) -> list[bytes]:
        """Encodes words in one text and cuts the tokens at those that open a word.

        Neither vocabulary has a token across a space; if the openings don't match the
        words one to one (a word holds the space mark itself), they are encoded one by one.
        """
        text = " ".join(words)
        pieces = self.model.encode(text)
        tokens = np.array(self.ranks.encode_ordinary(" " + text))
        at = np.flatnonzero(self.opens_piece[pieces]).tolist()
        opened = np.flatnonzero(self.opens_token[tokens])
        if "▁" in text or len(at) != len(words) or len(opened) != len(words):
            each = self.model.encode(words, num_threads=1)
            return [_packed(p, len(self.ranks.encode_ordinary(" " + w))) for w, p in zip(words, each, strict=True)]
        counts = np.diff(opened, append=len(tokens)).tolist()
        return [_packed(pieces[i:j], n) for i, j, n in zip(at, [*at[1:], len(pieces)], counts, strict=True)]

    def of(self, words: list[str]) -> list[bytes]:
        """Pieces and rank tokens of each word, as it stands after a space, packed as by ``_packed``."""
        memo, older = self.memo, self.older
        missing = set(words).difference(memo)
        new = []
        for w in missing:
            got = older.get(w)
            if got is None:
                new.append(w)
            else:
                memo[w] = got
        if new:
            memo.update(zip(new, self._encoded(new), strict=True))
        out = [memo[w] for w in words]
        for w in new:
            if len(w) > MEMO_CHARS:
                del memo[w]
        if len(memo) >= MEMO_WORDS:
            self.older, self.memo = memo, {}
        return out


def vocabularies(model_path: str, ranks_path: str, pattern: str) -> Vocabularies:
    return held(("fertility", model_path, ranks_path, pattern), lambda: Vocabularies(model_path, ranks_path, pattern))


def repeated_words(words: list[str], width: int) -> int:
    """Words inside width-word windows that occur twice or more in the list."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    hashes = window_hashes(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), width)
    order = np.argsort(hashes, kind="stable")
    equal = hashes[order[1:]] == hashes[order[:-1]]
    if not equal.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    windows = [(i, tuple(words[i : i + width])) for i in np.flatnonzero(twice).tolist()]
    times = Counter(w for _, w in windows)
    edges = np.zeros(len(words) + 1, np.int64)
    for i, w in windows:
        if times[w] > 1:
            edges[i] += 1
            edges[i + width] -= 1
    return int((np.cumsum(edges) > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) == len(set(lines)):
        return 0
    seen, n = set(), 0
    for line in lines:
        if line in seen:
            n += WORD.search(line) is not None
        else:
            seen.add(line)
    return n


FIELDS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "chars_per_token": "double", "chars_per_piece": "double", "byte_share": "double", "token_entropy": "double",
    "band": "string", "base_failed": "boolean", "kept": "boolean",
}


def measured(text: str, lang: str | None, vocab: Vocabularies, bands: Mapping[str, Band], window: int) -> tuple:
    """The values of FIELDS for one text."""
    words = WORD.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    repeats = repeated_words(words, window)
    failed = n < 20 or 100 * repeats > 30 * n
    band = lang if lang in bands and lang not in SCRIPT_BANDS else script_of(text)
    if not n:
        return 0, 0, symbols, 0, 0, None, None, None, None, band, True, False
    found, counts = np.unique(np.frombuffer(b"".join(vocab.of(words)), np.uint16), return_counts=True)
    n_tokens = max(1, int(counts[-1])) if found[-1] == NO_PIECE else 1
    if found[-1] == NO_PIECE:
        found, counts = found[:-1], counts[:-1]
    total = int(counts.sum())
    per_token = chars / n_tokens
    share = int(counts[vocab.is_byte[found]].sum()) / total
    entropy = math.log2(total) - float((counts * np.log2(counts)).sum()) / total
    _, high, most_bytes, least_entropy = bands[band]
    inside = lower_limit(bands[band], n_tokens) <= per_token <= high and share <= most_bytes and entropy >= least_entropy
    return n, chars, symbols, repeated_lines(text), repeats, per_token, chars / total, share, entropy, band, failed, inside and not failed


def quality_rules(
    docs: DataFrame,
    model_path: str,
    ranks_path: str,
    pattern: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str | None = "lang",
    bands: Mapping[str, Band] = BANDS,
    window: int = 8,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: id, the ``carry`` columns, and FIELDS.

    Narrow: one pass over id, text, language and carried columns, no shuffle.  A null or
    wordless text has no words, null measures, and is rejected; a null language takes the
    band of the text's script; ids may be null or repeated, each row is judged alone;
    columns that are not named are not read, so their names cannot clash.
    """
    bands = dict(bands)
    lang = F.col(lang_col) if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    picked = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"), lang.cast("string").alias("_lang"), F.col(id_col), *carry)
    kinds = ", ".join(f"`{k}` {v}" for k, v in FIELDS.items())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[2:]) + ", " + kinds
    arrow = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabularies(model_path, ranks_path, pattern)
        for batch in batches:
            langs = batch.column(1).to_pylist()
            rows = [measured(t.as_py(), lang, vocab, bands, window) for t, lang in zip(batch.column(0), langs, strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(FIELDS)
            made = [pa.array(c, arrow[k]) for c, k in zip(columns, FIELDS.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *made], names=[*batch.schema.names[2:], *FIELDS])

    return picked.mapInArrow(run, schema)


def fit_lower_limits(measured: DataFrame, good: DataFrame, *, id_col: str = "doc_id", slack: float = 0.03, most_rows: int = 500) -> DataFrame:
    """(band, min_chars_per_token, n): the median of good rows of each band, less ``slack``.

    ``measured`` is from ``quality_rules``, ``good`` holds ids of rows labelled good.  The fit
    takes the ``most_rows`` rows of each band with the least hash of the id, a bound on the
    sample and on the only sorted group.
    """
    passed = measured.where(~F.col("base_failed")).join(good.select(id_col).distinct(), id_col, "left_semi")
    place = F.row_number().over(Window.partitionBy("band").orderBy(F.xxhash64(id_col), id_col))
    sample = passed.withColumn("_place", place).where(F.col("_place") <= most_rows)
    return sample.groupBy("band").agg((F.median("chars_per_token") - slack).alias("min_chars_per_token"), F.count("*").alias("n"))
