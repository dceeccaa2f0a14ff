"""Language identification by unigram pieces, summed over all segmentations.

The pieces are a fixed public vocabulary. Each language gets piece probabilities by
expectation maximisation over the whole words of a bounded sample of labelled texts, in a
task of its own. A text is
scored by the forward algorithm, which sums the probabilities of all segmentations of
each of its words; the score is the posterior of the best language under equal priors.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, unused

#: Bound of what is learned from: distinct texts a language (expected number), with all of their words.
TEXTS_PER_LANG = 1_000
SMOOTHING, UNKNOWN, EM_STEPS = 0.01, 1e-8, 3
#: Longer words go through recursions that can't underflow.
UNIT = 24
#: Scored words that a task remembers, and characters that are scored or learned from at once.
CACHE, BATCH_CHARS = 300_000, 200_000
#: Characters of long words that are learned from at once.
LONG_CHARS = 500_000


#: What Python's split() takes for white space.
BLANKS = r"[\s\p{Z}\x0B\x1C-\x1F\x85]+"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _finish(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ np.uint64(k)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _hash(piece: str) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for c in piece:
        h = h * _STEP + np.uint64(ord(c))
    return _finish(h, len(piece))[0]


def load_pieces(path: str) -> list[str]:
    """The text pieces of a sentencepiece model: no control, unknown or byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


def words_of(text: str) -> list[str]:
    return text.lower().split()


class Model:
    """Piece probabilities by language. Row 0 of ``prob`` is for no piece, row 1 for an unknown character."""

    def __init__(self, pieces: list[str], langs: list[str]):
        self.langs, self.longest = langs, max(map(len, pieces), default=1)
        self.row = {p: i + 2 for i, p in enumerate(pieces)}
        self.prob = np.zeros((len(pieces) + 2, len(langs)))
        hashes = np.array([_hash(p) for p in pieces], np.uint64) if pieces else np.zeros(1, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.hash_rows = hashes[order], order.astype(np.int32) + 2
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(hashes >> np.uint64(44)).astype(np.int64)] = True
        self.prob[1] = UNKNOWN

    def _rows(self, words: list[str], n: int) -> np.ndarray:
        """(word, end, length - 1): rows of the pieces that end there; all words have n characters.

        Substrings are looked up by hash, first in a bit table and then, if they pass, among the pieces.
        """
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), n).astype(np.uint64)
        longest = min(self.longest, n)
        out, h = np.zeros((len(words), n, longest), np.int32), np.zeros_like(codes)
        out[:, :, 0] = 1
        for k in range(1, longest + 1):
            h = h[:, : n - k + 1] * _STEP + codes[:, k - 1 :]
            x = _finish(h, k)
            w, at = np.nonzero(self.bits[(x >> np.uint64(44)).astype(np.int64)])
            x = x[w, at]
            found = np.minimum(np.searchsorted(self.hashes, x), len(self.hashes) - 1)
            hit = self.hashes[found] == x
            out[w[hit], at[hit] + k - 1, k - 1] = self.hash_rows[found[hit]]
        return out

    def _forward(self, rows: np.ndarray, prob: np.ndarray) -> np.ndarray:
        a = np.zeros((rows.shape[0], rows.shape[1] + 1, prob.shape[1]))
        a[:, 0] = 1
        for e in range(1, rows.shape[1] + 1):
            for k in range(1, min(e, rows.shape[2]) + 1):
                a[:, e] += a[:, e - k] * prob[rows[:, e - 1, k - 1]]
        return a

    def _scaled(self, words: list[str]) -> np.ndarray:
        """The log probabilities of words of any lengths, rescaled at each step."""
        n = max(map(len, words))
        rows, ends = self._rows([w.ljust(n, "\0") for w in words], n), np.array([len(w) for w in words])
        log, out = np.zeros((len(words), len(self.langs))), np.zeros((len(words), len(self.langs)))
        past = [np.ones_like(log)]
        for e in range(1, n + 1):
            now = sum(past[-k] * self.prob[rows[:, e - 1, k - 1]] for k in range(1, min(e, rows.shape[2], len(past)) + 1))
            log += np.log(now)
            out[ends == e] = log[ends == e]
            past = [x / now for x in past[max(0, len(past) - rows.shape[2] + 1) :]] + [np.ones_like(log)]
        return out

    def score(self, words: list[str]) -> np.ndarray:
        """Log probabilities, a row a word, a column a language."""
        out, by, long = np.zeros((len(words), len(self.langs))), defaultdict(list), []
        for i, w in enumerate(words):
            if len(w) >= UNIT:
                long.append(i)
            else:
                by[len(w) + 1].append(i)
        for n, at in by.items():
            for part in _parts(at, BATCH_CHARS // n):
                out[part] = np.log(self._forward(self._rows(["▁" + words[i] for i in part], n), self.prob)[:, -1])
        long.sort(key=lambda i: len(words[i]))
        while long:
            size = max(1, BATCH_CHARS // (len(words[long[-1]]) + 1))
            out[long[-size:]] = self._scaled(["▁" + words[i] for i in long[-size:]])
            del long[-size:]
        return out

    def _expected(self, r: np.ndarray, c: np.ndarray, p: np.ndarray) -> np.ndarray:
        """How often each piece is expected in segmentations of words with counts c."""
        n, most, seen = r.shape[1], r.shape[2], np.zeros(len(p))
        a, b = self._forward(r, p[:, None])[:, :, 0], np.zeros((len(r), n + 1))
        b[:, n] = 1
        for e, k in itertools.product(range(n, 0, -1), range(1, most + 1)):
            if k <= e:
                b[:, e - k] += b[:, e] * p[r[:, e - 1, k - 1]]
        for e, k in itertools.product(range(1, n + 1), range(1, most + 1)):
            if k <= e:
                x = r[:, e - 1, k - 1]
                seen += np.bincount(x, c * a[:, e - k] * p[x] * b[:, e] / a[:, n], len(p))
        return seen

    def _expected_short(self, words: list[str], c: np.ndarray, p: np.ndarray) -> np.ndarray:
        return self._expected(self._rows(words, len(words[0])), c, p)

    def _expected_long(self, words: list[str], c: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The same for words of any lengths, in logarithms."""
        n, ends = max(map(len, words)), np.array([len(w) for w in words])
        r, lp, seen = self._rows([w.ljust(n, "\0") for w in words], n), np.log(p, where=p > 0, out=np.full(len(p), -np.inf)), np.zeros(len(p))
        most, at = r.shape[2], np.arange(len(words))
        a, b = np.full((len(words), n + 1), -np.inf), np.full((len(words), n + 1), -np.inf)
        a[:, 0], b[at, ends] = 0, 0
        for e in range(1, n + 1):
            m = min(e, most)
            a[:, e] = np.logaddexp.reduce(a[:, e - m : e][:, ::-1] + lp[r[:, e - 1, :m]], axis=1)
        for s in range(n - 1, -1, -1):
            m = min(n - s, most)
            k = np.arange(m)
            b[:, s] = np.logaddexp(b[:, s], np.logaddexp.reduce(b[:, s + 1 : s + 1 + m] + lp[r[:, s + k, k]], axis=1))
        total = a[at, ends][:, None]
        for k in range(1, most + 1):
            x = r[:, k - 1 :, k - 1]
            seen += np.bincount(x.ravel(), (c[:, None] * np.exp(a[:, : n - k + 1] + lp[x] + b[:, k:] - total)).ravel(), len(p))
        return seen

    def _occurrences(self, words: list[str], c: np.ndarray) -> np.ndarray:
        n = max(map(len, words))
        r = self._rows([w.ljust(n, "\0") for w in words], n)
        return np.bincount(r.ravel(), np.repeat(c, r[0].size), len(self.prob))

    def learn_language(self, counts: dict[str, int], steps: int = EM_STEPS) -> np.ndarray:
        """The pieces' probabilities from whole words with counts, long ones too, such as those of scripts without spaces."""
        by, long = defaultdict(list), []
        for w in counts:
            if len(w) >= UNIT:
                long.append(w)
            else:
                by[len(w)].append(w)
        data = [(self._expected_short, part) for n, ws in by.items() for part in _parts(ws, BATCH_CHARS // (n + 1))]
        long.sort(key=len)
        while long:
            size = max(1, LONG_CHARS // (len(long[-1]) + 1))
            data.append((self._expected_long, long[-size:]))
            del long[-size:]
        data = [(how, ["▁" + w for w in part], np.array([counts[w] for w in part], float)) for how, part in data]
        seen = sum((self._occurrences(ws, c) for _, ws, c in data), np.zeros(len(self.prob)))
        for step in range(steps + 1):
            seen[:2] = 0
            p = (seen + SMOOTHING) / (seen.sum() + SMOOTHING * len(seen))
            p[0], p[1] = 0, UNKNOWN
            if step < steps:
                seen = sum((how(ws, c, p) for how, ws, c in data), np.zeros(len(p)))
        return p

    def fit(self, counts: dict[str, dict[str, int]], steps: int = EM_STEPS) -> Model:
        """counts: language to word to count."""
        for j, lang in enumerate(self.langs):
            self.prob[:, j] = self.learn_language(counts.get(lang, {}), steps)
        return self


def _parts(items: list, size: int) -> list[list]:
    size = max(1, size)
    return [items[lo : lo + size] for lo in range(0, len(items), size)]


def learn(rows: DataFrame, pieces: list[str], *, texts_per_lang: int = TEXTS_PER_LANG) -> Model | None:
    """A model from labelled rows (text, lang); None if they have no word.

    The sample takes texts by a hash, so that about ``texts_per_lang`` distinct ones of each
    language remain; all their words count. A language whose texts have no word is left out.
    """
    rows = rows.where("lang is not null and text is not null")
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("n")).collect()}
    if not n:
        return None
    share = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, int(min(1.0, texts_per_lang / v) * 1_000_000))])
    sample = rows.where(F.pmod(F.xxhash64("text", F.lit(9)), F.lit(1_000_000)) < share[F.col("lang")]).select("lang", "text").distinct()
    words = sample.select("lang", F.explode(F.split(F.lower("text"), BLANKS)).alias("w")).where("w <> ''").groupBy("lang", "w").count()

    def fit(words: pa.Table) -> pa.Table:  # of the bounded sample: a language is a task
        counts = dict(sorted(zip(words.column("w").to_pylist(), words.column("count").to_pylist(), strict=True)))
        return pa.table({"lang": words.column("lang").slice(0, 1).cast(pa.string()), "p": pa.array([Model(pieces, []).learn_language(counts)], pa.list_(pa.float64()))})

    learned = {r["lang"]: r["p"] for r in words.groupBy("lang").applyInArrow(fit, "lang string, p array<double>").collect()}  # a number a piece and language
    if not learned:
        return None
    model = Model(pieces, sorted(learned))
    model.prob[:] = np.array([learned[lang] for lang in model.langs]).T
    return model


def _predict(model: Model | None, drop_text: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[str, int] = {}
        known = np.zeros((0, len(model.langs) if model else 0))
        letter = regex.compile(r"\p{L}")
        for b in batches:
            lang, score = [], []
            for lo in range(0, len(b), 256):
                texts = b.column("text").slice(lo, 256).to_pylist()
                part = [words_of(t) if model and t and letter.search(t) else None for t in texts]
                if len(at) > CACHE:
                    at, known = {}, known[:0]
                new = list({w for ws in part if ws for w in ws if w not in at})
                if new:
                    at.update(zip(new, range(len(at), len(at) + len(new)), strict=True))
                    known = np.concatenate([known, model.score(new)])
                for ws in part:
                    if not ws:
                        lang.append("und")
                        score.append(0.0)
                        continue
                    total = known[[at[w] for w in ws]].sum(0)
                    best = int(total.argmax())
                    lang.append(model.langs[best])
                    score.append(float(1 / np.exp(total - total[best]).sum()))
            kept = [n for n in b.schema.names if not (drop_text and n == "text")]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*kept, *names])

    return run


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 4 = 2; null for null."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2


def label(docs: DataFrame, pieces: list[str], *, drop_text: bool = False, **bounds) -> DataFrame:
    """``docs`` (without text, if so asked) and lang_pred, score, under the names of unused() if docs has such columns.

    Nothing is learned from held-out rows, nor from rows without doc_id, text or lang.
    ``und`` with score 0: null text, no letter, or nothing to learn from. Equal texts get equal
    answers, however often they occur.
    """
    model = learn(docs.where(~held_out()).select("text", "lang"), pieces, **bounds)
    names = unused(docs, "lang_pred", "score")
    fields = [f for f in docs.schema if not (drop_text and f.name == "text")]
    schema = T.StructType([*fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.mapInArrow(lean(_predict(model, drop_text, names)), schema)


def identify(docs: DataFrame, pieces: list[str], **bounds) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score; see label()."""
    slim = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text", "lang")
    return label(slim, pieces, drop_text=True, **bounds).drop("lang")
