"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of its
labelled texts.  A text is parsed greedily into the longest phrases that occur
in the sample; the language that needs the fewest phrases, normalised by the
size of its sample, wins.  Texts are parsed whole: pieces of ``PIECE``
characters run through the automaton side by side, and each is then entered
again in the state in which its predecessor ended, until both parses of it are
in one state.  The phrases are those of a parse from the first character on.

Result of odd inputs: a null text and one without a letter get ``und`` with
score 0; with nothing to learn from every text gets ``und``; ties go to the
first language by name; repeated rows get equal results; an empty table gives
an empty result; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import ready, spread

#: Bounds of the sample: documents a language, characters of each, characters
#: a language, and characters in all, of which a language has the least many at least.
SAMPLE_DOCS, SAMPLE_DOC_CHARS, SAMPLE_CHARS, ALL_CHARS, LEAST_CHARS = 160, 400, 30_000, 120_000, 1_200
#: Step tables are dense up to so many symbols of a language and so many languages.
DENSE_SYMBOLS, DENSE_LANGUAGES = 64, 100
PIECE = 256
BATCH_CHARS = 2_000_000
UNKNOWN = "und"

_models: dict[tuple, Model] = {}


#: What stands between words: all but letters and the marks that belong to them.
_BETWEEN = re.compile(r"[\W\d_]+")
_MARK, _LETTER = r"\p{M}", r"\p{L}"


def clean(text: str) -> str:
    """Lower case, letters with their combining marks only, one space for
    whatever stands between them; a text without a letter has none at all."""
    low = text.lower()
    if low.isascii():
        return _BETWEEN.sub(" ", low)
    import regex

    if regex.search(_MARK, low) is None:
        return _BETWEEN.sub(" ", low)
    out = regex.sub(r"[^\p{L}\p{M}]+", " ", low)
    return out if regex.search(_LETTER, out) else " "


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring of ``codes``."""
    go, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        cur, p = len(go), last
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p != -1 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p != -1:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return go


class Step:
    """The automaton of one sample over the symbols of that sample.

    A step gives the next state, plus the number of phrases that end with it in
    the bits from 28 on.  A wide alphabet has a sorted list of transitions
    instead of a table."""

    def __init__(self, text: str, code: dict[str, int], dense: bool):
        import numpy as np

        local = {ch: i for i, ch in enumerate(sorted(set(text)))}
        self.width = len(local) + 1  # the last symbol is any that the sample has not
        self.symbol = np.full(len(code) + 1, len(local), np.int32)
        for ch, i in local.items():
            self.symbol[code[ch]] = i
        go = suffix_automaton([local[ch] for ch in text])
        root = np.zeros(self.width, np.int64)
        for c, to in go[0].items():
            root[c] = to
        restart = np.where(root > 0, root, 1 << 28)  # an unknown symbol is a phrase of its own
        if dense and self.width <= DENSE_SYMBOLS:
            table = np.empty((len(go), self.width), np.int64)
            table[0] = restart
            table[1:] = restart + (1 << 28)
            for s, out in enumerate(go):
                for c, to in out.items():
                    table[s, c] = to
            self.table = table.astype(np.int32).ravel()
        else:
            self.table = None
            self.restart = restart.astype(np.int32)
            found = sorted((s * self.width + c, to) for s, out in enumerate(go) for c, to in out.items())
            self.keys = np.array([k for k, _ in found] or [-1], np.int64)
            self.next = np.array([to for _, to in found] or [0], np.int32)

    def __call__(self, states, codes):
        import numpy as np

        c = self.symbol[codes]
        if self.table is not None:
            return self.table[states * self.width + c]
        key = states.astype(np.int64) * self.width + c
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.next[at], self.restart[c] + ((states > 0).astype(np.int32) << 28))


class Model:
    """Automata of all languages, over every character of their samples."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        import numpy as np

        texts = {lang: clean(text) for lang, text in samples}
        code = {ch: i + 1 for i, ch in enumerate(sorted(set().union(*texts.values())))}
        self.code = np.zeros(0x110000, np.int32)
        for ch, i in code.items():
            self.code[ord(ch)] = i
        self.languages = sorted(texts)
        self.steps = [Step(texts[lang], code, len(texts) <= DENSE_LANGUAGES) for lang in self.languages]
        self.bits = [math.log2(max(2, len(texts[lang]))) for lang in self.languages]

    def phrases(self, texts: list[str]):
        """Cleaned lengths, and phrases by text and language, of whole texts."""
        import numpy as np

        codes = self.code[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        pieces = -(-sizes // PIECE)
        of = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(np.cumsum(sizes) - sizes, pieces) + nth * PIECE
        width = np.minimum(PIECE, np.repeat(sizes, pieces) - nth * PIECE)
        order = np.argsort(-width, kind="stable")
        live = np.searchsorted(-width[order], -np.arange(PIECE), "left")  # pieces longer than j
        states = np.zeros((len(self.languages), len(of)), np.int32)
        ends = np.zeros_like(states)
        for j in range(PIECE):
            n = live[j]
            if not n:
                break
            c = codes[start[order[:n]] + j]
            for k, step in enumerate(self.steps):
                x = step(states[k, :n], c)
                ends[k, :n] += x >> 28
                states[k, :n] = x & 0xFFFFFFF
        found = np.zeros((len(texts), len(self.languages)), np.int64)
        last = np.flatnonzero(np.r_[of[1:] != of[:-1], True]) if len(of) else of
        for k, step in enumerate(self.steps):
            at, count = np.empty(len(of), np.int32), np.empty(len(of), np.int64)
            at[order], count[order] = states[k], ends[k]
            self._join(step, codes, start, width, nth, at, count)
            found[:, k] = np.bincount(of, weights=count, minlength=len(texts))
            found[of[last], k] += at[last] > 0  # the phrase that the end of the text cuts off
        return sizes, found

    @staticmethod
    def _join(step: Step, codes, start, width, nth, at, count) -> None:
        """Make parses of pieces that began anew those of whole texts: ``at``,
        the state in which each piece ends, and ``count``, its phrases."""
        import numpy as np

        entered = np.zeros(len(at), np.int32)  # the state in which each piece was entered
        todo = np.flatnonzero((nth > 0) & (np.r_[0, at[:-1]] > 0))
        while len(todo):
            new, old, changed = at[todo - 1], entered[todo], []
            entered[todo] = new
            rows, j = todo, 0
            while len(rows):
                c = codes[start[rows] + j]
                x, y = step(new, c), step(old, c)
                count[rows] += (x >> 28) - (y >> 28)
                new, old = x & 0xFFFFFFF, y & 0xFFFFFFF
                j += 1
                apart = new != old
                rows, new, old = rows[apart], new[apart], old[apart]
                over = width[rows] <= j
                if over.any():
                    at[rows[over]] = new[over]
                    changed.append(rows[over])
                    rows, new, old = rows[~over], new[~over], old[~over]
            todo = np.concatenate(changed) + 1 if changed else todo[:0]
            todo = todo[todo < len(nth)]
            todo = np.sort(todo[nth[todo] > 0])

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        import numpy as np

        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        cleaned = [clean(t) for t in texts]
        sizes, found = self.phrases(cleaned)
        rates = found * np.array(self.bits) / np.maximum(sizes, 1)[:, None]
        best = rates.argmin(1)
        low = np.sort(rates, 1)
        if low.shape[1] > 1:
            score = low[:, 1] / np.maximum(low[:, 0] + low[:, 1], 1e-12)
        else:
            score = np.ones(len(texts))
        named = zip(best, score, cleaned)
        return [(self.languages[b], float(s)) if t.strip() else (UNKNOWN, 0.0) for b, s, t in named]


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id mod 3 is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def unshared(texts: list[list[str]], width: int = 3) -> list[list[str]]:
    """Each text without the words of phrases that another text of the sample
    holds too: a passage of many documents says little of their language."""
    grams = [[tuple(t[i : i + width]) for i in range(len(t) - width + 1)] for t in texts]
    held = Counter(g for x in grams for g in set(x))
    out = []
    for words, x in zip(texts, grams):
        drop = {i + j for i, g in enumerate(x) if held[g] > 1 for j in range(width)}
        out.append([w for i, w in enumerate(words) if i not in drop])
    return out


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", usable: Column | None = None) -> tuple[tuple[str, str], ...]:
    """Bounded samples (language, text) of labelled documents: per language the
    SAMPLE_DOCS documents with the smallest hashed ids."""
    has = F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()
    rows = docs.where(has if usable is None else has & usable).select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"))
    order = Window.partitionBy("l").orderBy(F.xxhash64("i"), "i")
    ids = rows.withColumn("r", F.row_number().over(order)).where(f"r <= {SAMPLE_DOCS}").select(F.col("i").alias("_i")).distinct()
    middle = F.greatest(F.lit(1), (F.length(text_col) - SAMPLE_DOC_CHARS) / 2).cast("int")
    picked = docs.where(has).join(F.broadcast(ids), F.col(id_col) == F.col("_i"), "left_semi").select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.substring(F.col(text_col), middle, F.lit(SAMPLE_DOC_CHARS)).alias("t")).collect()
    size = max(LEAST_CHARS, min(SAMPLE_CHARS, ALL_CHARS // max(1, len({r.l for r in picked}))))
    by: dict[str, str] = {}
    rows = [(r.l, clean(r.t).split()) for r in sorted(picked, key=lambda r: (r.l, r.i, r.t))]
    for (lang, _), words in zip(rows, unshared([w for _, w in rows])):
        by[lang] = " ".join([by.get(lang, ""), *words])[:size]
    for lang, words in rows:
        by[lang] = by[lang] if by[lang].strip() else " ".join(words)[:size]
    return tuple(sorted(by.items()))


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every document, from its whole text alone."""
    ready(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        model = _models.get(samples)
        if model is None:
            _models.clear()
            model = _models[samples] = Model(samples)
        for b in batches:
            texts, got, held, size = b.column(1).to_pylist(), [], [], 0
            for t in texts:
                held.append(t or "")
                size += len(held[-1])
                if size >= BATCH_CHARS:
                    got += model.predict(held)
                    held, size = [], 0
            got += model.predict(held) if held else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return spread(rows).mapInArrow(run, "doc_id long, lang_pred string, score double")
