"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

Tokens are runs of ASCII letters, digits and ``_+/=-``; every token of a text is part of the chain. Tags are
outside, begin and inside, inside never after outside. A token's features are its own shape, the
words and signs around it, and figures of the whole file; those weigh secret against outside, and the
gap to the token before weighs inside against begin. Viterbi decodes the best tags.

Most tokens need no decoding: from the fitted weights follows the most that neighbours, file and
transitions can add to a token's own shape (:meth:`Field.slack`). A token whose shape falls short of
that is outside in the best labelling of any text, so the chain divides there without loss. Shapes
are judged once for each different token of a task.

The field is fitted on the driver, from windows of TRAIN_TOKENS tokens of at most about SAMPLE_ROWS
documents, chosen by hash: windows at values that the fixed patterns find, windows around other
digits, and windows at any place, TRAIN_WINDOWS of each. The found ones are used a second time without
their neighbours; and for each other one a copy is made in which a token's shape is that of a
generated key, so that neighbours alone can't decide. All bounds are parameters; features and tags
alone leave the executors. Every row is then scanned with the fitted weights.

Cases: a null text is empty; an empty text has no spans; equal rows get equal results; other columns
are ignored; an empty table gives an empty result; positions are code points, ends exclusive; very
long texts are scanned whole.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import scratch, ship, small_batches, stage

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")

TOKEN = re.compile(r"[A-Za-z0-9_+/=-]+")
DIGIT = re.compile(r"[0-9]")
SAMPLE_ROWS, TRAIN_WINDOWS, TRAIN_TOKENS, EPOCHS, BATCH = 20_000, 1500, 12, 6, 32
#: Characters that a training window may reach from its middle.
REACH = 300
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
#: Features are hashed into so many places for each template.
PLACES = 4096
SHAPE = ("kind", "length", "kind_length", "digits", "variety", "changes", "vowels", "consonants", "signs", "head", "shape")
AROUND = ("gap", "sign_before", "sign_after", "word-1", "word-2", "word+1")
FILE = ("file_tokens", "file_signs", "file_digits")
TEMPLATES = SHAPE + AROUND + FILE
GAP = TEMPLATES.index("gap")
#: Each sign's class: A, a, 0 or itself.
CLASSES = str.maketrans({c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} | {c: "a" for c in "abcdefghijklmnopqrstuvwxyz"} | {c: "0" for c in "0123456789"})
CONSONANTS = re.compile(r"[bcdfghjklmnpqrstvwxz]+")
REPEATS = re.compile(r"(.)\1+")
#: Different tokens whose judgement a task remembers.
REMEMBERED = 1 << 20


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, leftmost and without overlap within a kind, in order."""
    return sorted((m.start(), k, m.end()) for k, m in _base(text))


def _base(text: str) -> list[tuple[int, re.Match]]:
    found = []
    if ":" in text or "=" in text:
        found += [(0, m) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(1, m) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(2, m) for m in HEX.finditer(text)]


def values(text: str) -> list[tuple[int, int]]:
    """What the fixed patterns hold to be secret: the value without its key."""
    return sorted({m.span(2) if k == 0 else m.span() for k, m in _base(text)})


def _places(names: list[str], first: int) -> list[int]:
    return [(first + i) * PLACES + zlib.crc32(n.encode("utf-8", "surrogatepass")) % PLACES for i, n in enumerate(names)]


def shape_of(token: str) -> list[int]:
    """Places of the features of a token alone."""
    n, low = len(token), token.lower()
    upper = sum(map(str.isupper, token))
    digits = sum(map(str.isdigit, token))
    letters = sum(map(str.isalpha, token))
    inner = token[1:].translate(CLASSES)
    changes = sum(map(str.__ne__, inner, inner[1:]))
    vowels = sum(map(low.count, "aeiouy"))
    run = max(map(len, CONSONANTS.findall(low)), default=0)
    kind = f"{letters > upper:d}{upper > 0:d}{digits > 0:d}{letters + digits < n:d}"
    return _places(_names(n, kind, digits, len(set(token)), changes, vowels, letters, run, n - letters - digits, token[:4] if token[:4].isupper() else "-", REPEATS.sub(r"\1", token[:64].translate(CLASSES))[:10]), 0)


def _names(n: int, kind: str, digits: int, different: int, changes: int, vowels: int, letters: int, run: int, signs: int, head: str, shape: str) -> list[str]:
    """Values of the templates of SHAPE, in order."""
    size = min(n, 32) // 8
    return [
        kind, str(min(n, 64) // 4), f"{kind}{min(n, 48) // 8}", f"{int(6 * digits / n)}{n >= 16:d}", f"{int(8 * different / n)}{size}", f"{min(12, changes)}",
        f"{int(8 * vowels / max(1, letters))}{size}", str(min(8, run)), f"{min(4, signs)}", head, shape,
    ]


def around(text: str, spans: list[tuple[int, int]], i: int) -> list[int]:
    """Places of the features of what stands around token ``i``."""
    start, end = spans[i]
    word = lambda j: text[slice(*spans[j])][:32].lower() if 0 <= j < len(spans) else ""
    before = text[max(0, start - 8) : start].rstrip(" \"'")
    gap = text[spans[i - 1][1] : start][:3] if i else "^"
    return _places([gap, before[-1:], text[end : end + 1], word(i - 1), word(i - 2), word(i + 1)], len(SHAPE))


def file_of(text: str, tokens: int) -> list[int]:
    """Places of the features of the whole text."""
    size = max(1, len(text))
    signs, digits = (sum(map(text.count, x)) for x in ("={};", "0123456789"))
    return _places([str(tokens.bit_length() // 2), str(min(6, int(200 * signs / size))), str(min(6, int(100 * digits / size)))], len(SHAPE) + len(AROUND))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class Field:
    """Weights: ``secret`` of every feature for begin and inside, ``inside`` of a gap for inside, and steps between tags.

    An outside token stands before and after every chain.
    """

    def __init__(self) -> None:
        self.secret = np.zeros(len(TEMPLATES) * PLACES)
        self.inside = np.zeros(PLACES)
        self.steps = np.zeros((3, 3))
        self.steps[OUTSIDE, INSIDE] = -1e9

    def scores(self, places: np.ndarray) -> np.ndarray:
        """Of the three tags, for tokens by their places (last axis)."""
        secret = self.secret[places].sum(axis=-1)
        return np.stack([np.zeros_like(secret), secret, secret + self.inside[places[..., GAP] - GAP * PLACES]], axis=-1)

    def marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tag probabilities of chains of equal length: (chain, token, tag), and of steps, summed."""
        chains, n, _ = scores.shape
        ahead, back = np.empty_like(scores), np.empty_like(scores)
        ahead[:, 0] = scores[:, 0] + self.steps[OUTSIDE]
        for i in range(1, n):
            ahead[:, i] = scores[:, i] + _logsum(ahead[:, i - 1, :, None] + self.steps, 1)
        back[:, -1] = self.steps[:, OUTSIDE]
        for i in range(n - 2, -1, -1):
            back[:, i] = _logsum(self.steps + (scores[:, i + 1] + back[:, i + 1])[:, None, :], 2)
        total = _logsum(ahead[:, -1] + back[:, -1], 1)[:, None, None]
        tags = np.exp(ahead + back - total)
        between = np.exp(ahead[:, :-1, :, None] + self.steps + (scores[:, 1:] + back[:, 1:])[:, :, None, :] - total[..., None])
        steps = between.sum(axis=(0, 1))
        steps[OUTSIDE] += tags[:, 0].sum(axis=0)
        steps[:, OUTSIDE] += tags[:, -1].sum(axis=0)
        return tags, steps

    def fit(self, places: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS) -> Field:
        """Ascent of the conditional likelihood in small batches, each weight's step shrinking by what it has moved."""
        moved, moved_in, order = np.full_like(self.secret, 1e-2), np.full_like(self.inside, 1e-2), np.random.default_rng(0)
        for epoch in range(epochs if len(places) else 0):
            for at in np.array_split(order.permutation(len(places)), max(1, len(places) // BATCH)):
                own, truth = places[at], np.eye(3)[tags[at]]
                prob, steps = self.marginals(self.scores(own))
                error = truth - prob
                for weight, seen, where, change in (
                    (self.secret, moved, own, np.repeat((error[..., BEGIN] + error[..., INSIDE])[..., None], own.shape[-1], axis=-1)),
                    (self.inside, moved_in, own[..., GAP] - GAP * PLACES, error[..., INSIDE]),
                ):
                    sums = np.bincount(where.ravel(), change.ravel(), len(weight)) - 1e-3 * weight
                    seen += sums * sums
                    weight += 0.2 * sums / np.sqrt(seen)
                want = np.einsum("cti,ctj->ij", truth[:, :-1], truth[:, 1:])
                want[OUTSIDE] += truth[:, 0].sum(axis=0)
                want[:, OUTSIDE] += truth[:, -1].sum(axis=0)
                self.steps += 0.1 / (1 + epoch) * (want - steps) / len(at)
                self.steps[OUTSIDE, INSIDE] = -1e9
        return self

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """The best tags of one chain; ties go to the lower tag."""
        best, came = scores[0] + self.steps[OUTSIDE], []
        for row in scores[1:]:
            via = best[:, None] + self.steps
            came.append(via.argmax(axis=0))
            best = via.max(axis=0) + row
        tags = [int((best + self.steps[:, OUTSIDE]).argmax())]
        for step in reversed(came):
            tags.append(int(step[tags[-1]]))
        return tags[::-1]

    def slack(self) -> float:
        """The most that all else can add to a token's shape in favour of begin or inside.

        Take any labelling with the token at begin or inside; make it outside, and a following inside
        begin. This bounds what the change costs besides the token's own shape: the best weights of the
        templates around it and of the file, and the steps. So if its shape scores less than minus
        this, outside is better in every text.
        """
        by_template = self.secret.reshape(len(TEMPLATES), PLACES)[len(SHAPE) :].max(axis=1)
        gap = max(0.0, self.inside.max())
        m, worst = self.steps, -np.inf
        for a in range(3):
            for x in (BEGIN, INSIDE):
                own = gap if x == INSIDE else 0.0
                for b in (OUTSIDE, BEGIN):
                    worst = max(worst, own + m[a, x] + m[x, b] - m[a, OUTSIDE] - m[OUTSIDE, b])
                for c in range(3):
                    worst = max(worst, own + gap + m[a, x] + m[x, INSIDE] + m[INSIDE, c] - m[a, OUTSIDE] - m[OUTSIDE, BEGIN] - m[BEGIN, c])
        return float(np.maximum(by_template, 0).sum() + worst)

    def word_score(self, n: int, capital: bool, different: int, run: int, vowels: int) -> float:
        """What the shape of a lower-case or capitalised word of ``n`` letters scores."""
        kind, shape = f"{n > capital:d}{capital:d}00", "Aa" if capital else "a"
        return float(self.secret[_places(_names(n, kind, 0, different, 0, vowels, n, run, 0, "-", shape), 0)].sum())

    def packed(self) -> tuple:
        """What scanning needs, in few bytes: most weights are zero."""
        at = np.flatnonzero(self.secret)
        return at, self.secret[at], self.inside, self.steps

    @classmethod
    def unpacked(cls, at: np.ndarray, secret: np.ndarray, inside: np.ndarray, steps: np.ndarray) -> Field:
        field = cls()
        field.secret[at] = secret
        field.inside, field.steps = inside, steps
        return field


class Scanner:
    """Finds spans with a fitted field; remembers which tokens can be part of a secret at all."""

    def __init__(self, field: Field) -> None:
        self.field, self.least = field, -field.slack()
        self.words: dict[tuple[int, bool, int, int, int], bool] = {}
        self.never: set[str] = set()
        self.open: dict[str, list[int]] = {}

    def judge(self, tokens: set[str]) -> set[str]:
        """Those tokens that may be tagged begin or inside."""
        if len(self.never) + len(self.open) > REMEMBERED:
            self.never, self.open = set(), {}
        for token in tokens - self.never:
            if token in self.open:
                continue
            if self.plain_word(token) or float(self.field.secret[places := shape_of(token)].sum()) < self.least:
                self.never.add(token)
            else:
                self.open[token] = places
        return tokens - self.never

    def plain_word(self, token: str) -> bool:
        """Whether a token is a word that can't be part of a secret; words of equal figures have one score."""
        n, capital = len(token), token.istitle()
        if not (1 < n <= 64 and token.isalpha() and (capital or token.islower())):
            return False
        runs = [*map(len, CONSONANTS.findall(token.lower()))]
        key = n, capital, len(set(token)), max(runs, default=0), n - sum(runs)
        if key not in self.words:
            self.words[key] = self.field.word_score(*key) < self.least
        return self.words[key]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Secrets that the field finds: the open tokens are decoded, run by run."""
        wanted = self.judge(set(TOKEN.findall(text)))
        if not wanted:
            return []
        tokens = [m.span() for m in TOKEN.finditer(text)]
        whole = file_of(text, len(tokens))
        found, run = [], []
        for i, (start, end) in enumerate([*tokens, (0, 0)]):
            token = text[start:end]
            if token in wanted:
                run.append((i, self.open[token] + around(text, tokens, i) + whole))
            elif run:
                for (j, _), tag in zip(run, self.field.viterbi(self.field.scores(np.array([p for _, p in run]))), strict=True):
                    if tag == BEGIN:
                        found.append(tokens[j])
                    elif tag == INSIDE:
                        found[-1] = (found[-1][0], tokens[j][1])
                run = []
        return found

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        """All spans in order; the field's spans are added where no fixed one overlaps."""
        base = base_spans(text)
        extra = [(s, 3, e) for s, e in self.spans(text) if not any(a < e and s < b for a, _, b in base)]
        return sorted(base + extra)


def window_at(text: str, middle: int, secret: list[tuple[int, int]]) -> tuple[list[list[int]], list[int]] | None:
    """Features without the file's, and tags, of TRAIN_TOKENS tokens around a place."""
    low = max(0, middle - REACH)
    tokens = [(a + low, z + low) for a, z in (m.span() for m in TOKEN.finditer(text[low : middle + REACH]))]
    first = max(0, sum(z <= middle for _, z in tokens) - TRAIN_TOKENS // 2)
    if len(tokens) < first + TRAIN_TOKENS:
        first = max(0, len(tokens) - TRAIN_TOKENS)
    if len(tokens) < TRAIN_TOKENS:
        return None
    rows, tags, last = [], [], None
    for i in range(first, first + TRAIN_TOKENS):
        start, end = tokens[i]
        hit = next((s for s in secret if s[0] < end and start < s[1]), None)
        tags.append(OUTSIDE if hit is None else INSIDE if hit == last else BEGIN)
        last = hit
        rows.append(shape_of(text[start:end]) + around(text, tokens, i))
    return rows, tags


def windows_of(text: str) -> list[tuple[int, list[list[int]], list[int]]]:
    """(class, features, tags): windows at found values (0), at other digits (1), at any place (2), from a place that the text's checksum gives."""
    secret, out = values(text), []
    whole = file_of(text, len(TOKEN.findall(text)))
    places = [(0, s[0]) for s in secret[:2]]
    any_place = zlib.crc32(text.encode("utf-8", "surrogatepass")) % len(text)
    digit = next((m.start() for m in DIGIT.finditer(text, any_place) if not any(a <= m.start() < z for a, z in secret)), None)
    places += [(1, digit)] if digit is not None else []
    for kind, place in [*places, (2, any_place)]:
        if found := window_at(text, place, secret):
            rows, tags = found
            if kind == 0 or not any(tags):
                out.append((kind, [r + whole for r in rows], tags))
    return out


def made_key(rng: random.Random) -> str:
    """A key as services issue them: random signs of one of several alphabets."""
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabet, least, most = rng.choice([(upper + lower + digits, 16, 48), (upper + lower, 20, 48), (lower + digits, 16, 40), (upper + digits, 16, 40), (upper + lower + digits + "+/", 24, 64), ("0123456789abcdef", 24, 64), (upper + lower + digits + "_-", 20, 48)])
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(least, most)))


def made_plain(rng: random.Random) -> str:
    """What looks unusual and is no secret: long words, names of code, numbers, dates, paths."""
    say = lambda n: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(n))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    return rng.choice([
        lambda: say(rng.randint(6, 14)), lambda: say(2) + say(2).title() + say(rng.randint(1, 4)).title(), lambda: "_".join(say(2) for _ in range(rng.randint(2, 6))), lambda: digits(rng.randint(5, 20)),
        lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: "/".join(say(rng.randint(1, 4)) for _ in range(rng.randint(2, 7))), lambda: say(rng.randint(2, 5)).upper(), lambda: "-".join(digits(4) for _ in range(4)),
        lambda: say(3) + digits(rng.randint(1, 4)), lambda: "-" * rng.randint(3, 60), lambda: "=" * rng.randint(3, 60), lambda: say(1) * rng.randint(4, 20),
    ])()


def examples(found: list[tuple[int, list[list[int]], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Places and tags of all training chains, the made ones included; the same for the same windows."""
    rng, rows, tags = random.Random(1), [], []
    blank = np.array(_places(["?"] * len(AROUND), len(SHAPE)))
    for kind, feats, marks in found:
        own = np.array(feats)
        rows.append(own)
        tags.append(marks)
        if kind == 0:
            bare = own.copy()
            bare[:, len(SHAPE) : len(SHAPE) + len(AROUND)] = blank
            rows.append(bare)
            tags.append(marks)
            continue
        for make, tag in ((made_key, BEGIN), (made_plain, OUTSIDE)):
            own, at = np.array(feats), rng.randrange(TRAIN_TOKENS)
            own[at, : len(SHAPE)] = shape_of(make(rng))
            rows.append(own)
            tags.append([tag if i == at else OUTSIDE for i in range(TRAIN_TOKENS)])
    if not rows:
        return np.zeros((0, TRAIN_TOKENS, len(TEMPLATES)), np.int64), np.zeros((0, TRAIN_TOKENS), np.int64)
    return np.array(rows), np.array(tags)


def training_windows(docs: DataFrame, sample: int = SAMPLE_ROWS, most: int = TRAIN_WINDOWS) -> list[tuple[int, list[list[int]], list[int]]]:
    """Windows of the sampled documents, those with the smallest hashes of each class."""
    small_batches(docs.sparkSession)
    total = docs.count()
    share = min(1.0, sample / max(1, total))
    h = F.shiftrightunsigned(F.xxhash64(F.lit("crf"), "text"), 11)
    rows = docs.select("text").where("text <> ''").where(h < int(share * 2**53)).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, dict[int, str]] = {0: {}, 1: {}, 2: {}}
        for batch in batches:
            for text in batch.column("text"):
                for kind, feats, tags in windows_of(text.as_py()):
                    x = ";".join(",".join(map(str, f)) + f":{t}" for f, t in zip(feats, tags, strict=True))
                    seen[kind][zlib.crc32(x.encode()) << 8 | len(x) & 255] = x
            for kind, of in seen.items():
                if len(of) > 4 * most:
                    seen[kind] = dict(sorted(of.items())[:most])
        out = [(k, *x) for k, of in seen.items() for x in sorted(of.items())[:most]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.string()))], names=["kind", "h", "x"])

    with scratch():
        found = stage(rows.mapInArrow(run, "kind int, h long, x string").groupBy("kind", "h").agg(F.min("x").alias("x")), "training-windows")
        least = [r for k in range(3) for r in found.where(F.col("kind") == k).orderBy("h").limit(most).collect()]
    out = []
    for r in least:
        pairs = [p.split(":") for p in r.x.split(";")]
        out.append((r.kind, [list(map(int, f.split(","))) for f, _ in pairs], [int(t) for _, t in pairs]))
    return out


def fitted(docs: DataFrame) -> Field:
    return Field().fit(*examples(training_windows(docs)))


def spans(docs: DataFrame, columns: list[str], field: Field | None = None) -> DataFrame:
    """The chosen columns of every row, and ``found``: an array of (start, kind, end, value)."""
    packed = (field or fitted(docs)).packed()
    small_batches(docs.sparkSession)
    types = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns] + ["found array<struct<start:long,kind:string,end:long,value:string>>"])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(Field.unpacked(*packed))
        for batch in batches:
            found = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                found.append([{"start": s, "kind": KINDS[k], "end": e, "value": text[s:e]} for s, k, e in scanner.scan(text)])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(found, kind)], names=[*columns, "found"])

    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(run, types)


def op3_crf_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = spans(docs, ["doc_id"])
    written = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("found", lambda x: x["kind"] != "crf")
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *(count(k) for k in KINDS),
        F.sha2(F.array_join(F.transform(base, written), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", written), ",").alias("spans"),
    )


ship(__name__)
