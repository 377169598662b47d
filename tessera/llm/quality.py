"""Quality rules by tokeniser fertility.

Each text, its white space made single spaces, is segmented by a public vocabulary with byte fallback.
Three figures follow for a text: characters per token, the share of byte-fallback tokens, and the
entropy of its tokens in stretches of equal length, relative to what that length allows. A text outside the band of
its language (or, for an unlisted language, of its main script) is rejected. The bands are fixed
parameters; nothing is fitted to a corpus, so a verdict never depends on other rows.

Cases: a null text counts as empty; empty texts have no words and fail the base rule; equal rows get
equal verdicts; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import ship, small_batches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Tokens that entropy is taken over at a time.
STRETCH = 256
#: Different words whose tokens a task remembers, besides those of one text.
REMEMBERED = 1 << 18


@dataclass(frozen=True)
class Band:
    """What is accepted: characters per token from and to, byte-fallback share up to, relative entropy from."""

    least_chars: float
    most_chars: float
    most_fallback: float
    least_entropy: float


#: Fixed bands by language, and by main script for other languages. The lower bounds of en, de, fr and es
#: are the 0.5th percentile of the labelled good documents of sf0.1, less 0.02 characters and 0.005 entropy.
#: Nothing labelled has fallbacks or lies above, and natural prose has longer tokens than those texts, so
#: the upper bounds are wide. No labelled document is of another language: the bands by script aren't measured.
BANDS = {
    "en": Band(2.039, 7.0, 0.02, 0.762),
    "de": Band(2.054, 7.0, 0.02, 0.755),
    "fr": Band(1.750, 7.0, 0.02, 0.745),
    "es": Band(1.783, 7.0, 0.02, 0.740),
    "latin": Band(1.2, 8.0, 0.05, 0.40),
    "cyrillic": Band(0.9, 7.0, 0.10, 0.40),
    "cjk": Band(0.3, 2.5, 0.80, 0.30),
    "other": Band(0.2, 8.0, 0.95, 0.30),
}


class Segmenter:
    """Tokens of texts; loaded once per task. Tokens never cross a space, so each different word is segmented once."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.fallback = np.array([self.sp.is_byte(i) or self.sp.is_unknown(i) for i in range(self.sp.get_piece_size())])
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.first, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)  # by number of the word
        self.flat, self.used = np.zeros(1 << 14, np.int32), 0

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the words, in order; new ones are segmented."""
        if len(self.number) > REMEMBERED:
            self.forget()
        number = self.number
        if fresh := list(set(words).difference(number)):
            self.add(fresh)
        return np.array([number[w] for w in words], dtype=np.int64)

    def add(self, fresh: list[bytes]) -> None:
        pieces = self.sp.encode([w.decode("utf-8", "replace") for w in fresh], num_threads=1)
        at, lengths = len(self.number), np.array([len(x) for x in pieces], dtype=np.int64)
        ends = self.used + np.cumsum(lengths)
        while at + len(fresh) > len(self.first):
            self.first, self.size = np.concatenate([self.first, self.first]), np.concatenate([self.size, self.size])
        while ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.first[at : at + len(fresh)], self.size[at : at + len(fresh)] = ends - lengths, lengths
        self.flat[self.used : ends[-1]] = np.fromiter(chain.from_iterable(pieces), np.int32, int(lengths.sum()))
        self.used = int(ends[-1])
        self.number.update(zip(fresh, range(at, at + len(fresh)), strict=True))

    def tokens(self, ids: np.ndarray) -> np.ndarray:
        """Tokens of the words joined by single spaces, by the words' numbers in text order."""
        n = self.size[ids]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.first[ids], n)
        return self.flat[at]


def relative_entropy(tokens: np.ndarray) -> float:
    """Mean of the entropy in stretches of STRETCH tokens, as a share of what a stretch of that length allows.

    The last stretch may be shorter; stretches count by their length, one of a single token as 1. So
    texts of any length are measured alike.
    """
    stretch = np.arange(len(tokens)) // STRETCH
    cells, counts = np.unique(stretch * np.int64(1 << 32) + tokens, return_counts=True)
    size, first = np.bincount(stretch), cells >> 32
    share = counts / size[first]
    entropy = np.bincount(first, -share * np.log2(share))
    return float((np.where(size > 1, entropy / np.log2(np.maximum(size, 2)), 1.0) * size).sum() / len(tokens))


def script_of(text: str) -> str:
    """Main script of all characters; ``other`` without letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    counts = {
        "latin": int(((codes >= 0x41) & (codes < 0x250)).sum()),
        "cyrillic": int(((codes >= 0x400) & (codes < 0x530)).sum()),
        "cjk": int(((codes >= 0x3040) & (codes < 0xA000) | (codes >= 0xAC00) & (codes < 0xD7B0)).sum()),
        "other": int((codes >= 0x250).sum()) // 2,
    }
    return max(counts, key=counts.get) if any(counts.values()) else "other"


def measure(text: str | None, lang: str | None, segmenter: Segmenter, bands: dict[str, Band] = BANDS) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, chars_per_token, fallback_share, entropy, kept."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # ASCII white space only
    n = len(words)
    word_chars = len(text) - sum(map(text.count, "\t\n\x0b\x0c\r "))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip("\t\n\x0b\x0c\r ")]
    n_dup_lines = len(lines) - len(set(lines))
    ids = segmenter.numbers(words)
    n_repeat = 0
    if n >= 4:
        if ids.max() < 1 << 21:
            codes = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
        else:  # pairs are numbered first, so that codes can't overflow
            pairs = np.unique(ids[:-1] * (ids.max() + 1) + ids[1:], return_inverse=True)[1]
            codes = pairs[:-1] * np.int64(n) + ids[2:]
        _, code, count = np.unique(codes, return_inverse=True, return_counts=True)
        hit = np.zeros(n, dtype=bool)
        at = np.flatnonzero(count[code] > 1)
        hit[at] = hit[at + 1] = hit[at + 2] = True
        n_repeat = int(hit.sum())
    base_failed = n < MIN_WORDS or 100 * n_repeat > 50 * n
    if not n:
        return 0, word_chars, n_symbols, n_dup_lines, 0, True, None, None, None, False
    tokens = segmenter.tokens(ids)
    total = len(tokens)
    if not total:
        return n, word_chars, n_symbols, n_dup_lines, n_repeat, base_failed, None, None, None, False
    relative = relative_entropy(tokens)
    fallback = float(segmenter.fallback[tokens].mean())
    chars = word_chars / total
    band = bands.get(lang or "") or bands[script_of(text)]
    fits = band.least_chars <= chars <= band.most_chars and fallback <= band.most_fallback and relative >= band.least_entropy
    return n, word_chars, n_symbols, n_dup_lines, n_repeat, base_failed, chars, fallback, relative, bool(fits and not base_failed)


FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, chars_per_token double, fallback_share double, token_entropy double, kept boolean"


def figures(docs: DataFrame, columns: list[str], vocabulary: str = VOCABULARY, bands: dict[str, Band] = BANDS) -> DataFrame:
    """The chosen columns of every row with its figures and verdict; one pass without a shuffle."""
    small_batches(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        model = f.read()  # read by the driver; executors need no file
    names = [c.split()[0] for c in FIGURES.split(", ")]
    has_lang = "lang" in docs.columns
    types = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns] + [FIGURES])
    kept = list(dict.fromkeys([*columns, "text", *(["lang"] if has_lang else [])]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(model)
        for batch in batches:
            langs = batch.column("lang").to_pylist() if has_lang else [None] * batch.num_rows
            rows = [measure(t.as_py(), lang, segmenter, bands) for t, lang in zip(batch.column("text"), langs, strict=True)]
            cells = list(zip(*rows, strict=True)) or [[]] * len(names)
            kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.float64()] * 3 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(x, k) for x, k in zip(cells, kinds, strict=True)], names=[*columns, *names])

    return docs.select(*kept).mapInArrow(run, types)


def accepted(docs: DataFrame, **options) -> DataFrame:
    """Rows that pass, with their own columns unchanged. Columns named as a figure keep their values."""
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" if c not in ("text", "lang") else c for i, c in enumerate(columns)])
    return figures(plain, plain.columns, **options).where("kept").select(*plain.columns).toDF(*columns)


def op9_tokeniser_fertility(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return figures(docs.select("doc_id", "text", "lang"), ["doc_id"])


ship(__name__)
