"""Language identification of (mixed-language) texts.

A word is a maximal run of ASCII letters and non-ASCII characters that holds a
letter. Its script (by Unicode ranges) narrows the languages to those whose
training text uses it; each candidate scores the word by a character trigram
model. Viterbi over the words, with a penalty for each switch of
language, labels spans. A text's language is the one of most letters; its
score is that language's share of the letters times the posterior of the
language on its own words.

The model is fitted on a bounded sample of labelled rows (``sample_rows`` of
each language expected, chosen by a hash of the text; whole texts) and hashed
into tables of fixed size; prediction reads every whole text.

Defined cases: null texts and texts without a letter are ``und`` with score 0
and no spans; so is everything if nothing was learned. Rows with null
labels aren't learned from. Equal shares: the language first in code point
order. Words in a script no language uses score all languages alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payguard.llm.common import fold
from payguard.llm.textops import U64, Texts, mix64, slices

SLOTS = (1 << 14, 1 << 14, 1 << 16)  # of the tables of character 1-, 2- and 3-grams
SAMPLE_ROWS = 2_000
SWITCH_PENALTY = 12.0
MIN_SCRIPT_SHARE = 0.002  # of a language's letters, for the script to admit the language
BACKOFF = 5.0             # pseudo counts of the next shorter n-gram
BLOCK = 32                # words of a Viterbi block
SLICE_BYTES = 1 << 20     # text handled at a time
UND = "und"

# Scripts by ranges of Unicode code points (first, last).
SCRIPTS = (
    ("Latin", ((0x41, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A))),
    ("Greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("Cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("Armenian", ((0x530, 0x58F),)),
    ("Hebrew", ((0x590, 0x5FF), (0xFB1D, 0xFB4F))),
    ("Arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("Devanagari", ((0x900, 0x97F), (0xA8E0, 0xA8FF))),
    ("Bengali", ((0x980, 0x9FF),)),
    ("Gurmukhi", ((0xA00, 0xA7F),)),
    ("Gujarati", ((0xA80, 0xAFF),)),
    ("Tamil", ((0xB80, 0xBFF),)),
    ("Telugu", ((0xC00, 0xC7F),)),
    ("Kannada", ((0xC80, 0xCFF),)),
    ("Malayalam", ((0xD00, 0xD7F),)),
    ("Thai", ((0xE00, 0xE7F),)),
    ("Georgian", ((0x10A0, 0x10FF), (0x1C90, 0x1CBF))),
    ("Ethiopic", ((0x1200, 0x139F),)),
    ("Hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("Kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF))),
    ("Han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))),
)
OTHER = len(SCRIPTS)


@lru_cache(maxsize=1)
def _character_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter, and the number of its script."""
    script = np.full(0x110000, OTHER, np.int8)
    for k, (_, ranges) in enumerate(SCRIPTS):
        for a, b in ranges:
            script[a:b + 1] = k
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000), script


class Words:
    """The words of a slice of texts: starts and ends (bytes), first (of each
    text, one more than texts), kind (index among the distinct words), and of
    the distinct words: letters, script, slots (their n-grams), begin."""

    def __init__(self, col: pa.Array):
        t = Texts(col)
        starts, ends, first = t.runs(letters=True)
        _, at, kind = np.unique(t.hashes(starts, ends), return_index=True, return_inverse=True)
        raw = t.data.tobytes()
        joined = "\n".join([raw[i:j].decode("utf-8", "replace") for i, j in zip(starts[at].tolist(), ends[at].tolist())])
        cp = np.frombuffer(f"\n{joined.lower()}\n".encode("utf-32-le"), "<u4").astype(np.int64)
        is_letter, script_of = _character_tables()
        if not len(at):
            cp = np.array([10, 10])
        edge = np.flatnonzero(cp == 10)
        letter = is_letter[cp]
        count = np.concatenate([[0], np.cumsum(letter)])
        self.letters = count[edge[1:]] - count[edge[:-1]]
        which = np.repeat(np.arange(len(edge) - 1), np.diff(edge))[letter[:-1]]
        scripts = np.bincount(which * (OTHER + 1) + script_of[cp[:-1][letter[:-1]]], minlength=len(at) * (OTHER + 1))
        self.script = scripts.reshape(-1, OTHER + 1).argmax(1) if len(at) else np.zeros(0, np.int64)
        # the k-th n-gram ends at character k; a word's n-grams end in its characters and its closing edge
        c = cp.astype(U64)
        pairs = mix64((c[:-1] << U64(21)) | c[1:])
        tri = np.concatenate([[U64(0)], mix64(pairs[:-1] * U64(0x9E3779B97F4A7C15) + c[2:])])
        self.slots = ((mix64(c[:-1]) % U64(SLOTS[0])).astype(np.int32), (mix64(c[1:]) % U64(SLOTS[0])).astype(np.int32),
                      (pairs % U64(SLOTS[1])).astype(np.int32), (tri % U64(SLOTS[2])).astype(np.int32))
        self.begin = edge[:-1]
        use = self.letters[kind] > 0 if len(kind) else np.zeros(0, bool)
        kept = np.concatenate([[0], np.cumsum(use)])
        self.starts, self.ends, self.kind, self.first = starts[use], ends[use], kind[use], kept[first]
        self.bytes = raw


def _count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) rows to (lang, order, slot, n); order 0 counts letters by script."""
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            langs = np.array(part.column(0).to_pylist())
            for lang in np.unique(langs):
                w = Words(part.column(1).filter(pa.array(langs == lang)))
                n = np.bincount(w.kind, minlength=len(w.letters)).astype(float)
                if not len(w.kind):
                    continue
                per = np.repeat(n, np.diff(np.append(w.begin, len(w.slots[0]))))
                for order, slot, weight in ((0, w.script, n * w.letters), (1, w.slots[1], per), (2, w.slots[2], per), (3, w.slots[3], per)):
                    total = np.bincount(slot, weight)
                    hit = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([str(lang)] * len(hit), pa.string()), pa.array([order] * len(hit), pa.int32()),
                        pa.array(hit.astype(np.int32)), pa.array(total[hit].astype(np.int64))], ["lang", "order", "slot", "n"])


class Model:
    """Languages (sorted), whether each script admits each, and log-scores."""

    def __init__(self, rows: list):
        self.langs = sorted({r["lang"] for r in rows})
        at = {x: i for i, x in enumerate(self.langs)}
        size = (OTHER + 1, *SLOTS)
        self.n = [np.zeros((s, len(at)), np.float32) for s in size]
        for r in rows:
            self.n[r["order"]][r["slot"], at[r["lang"]]] += r["n"]
        if self.langs:
            share = self.n[0] / np.maximum(self.n[0].sum(0), 1)
            self.admits = (share >= MIN_SCRIPT_SHARE) & (np.arange(OTHER + 1) < OTHER)[:, None]
            one = (self.n[1] + 0.5) / (self.n[1].sum(0) + 0.5 * SLOTS[0])
            self.one = one.astype(np.float32)

    def words(self, w: Words) -> np.ndarray:
        """Log-score of each distinct word in each language (scripts it
        doesn't use: far below)."""
        before, last, pair, tri = w.slots
        two = (self.n[2][pair] + BACKOFF * self.one[last]) / (self.n[1][before] + BACKOFF)
        context = np.concatenate([[pair[0]], pair[:-1]])
        three = np.log((self.n[3][tri] + BACKOFF * two) / (self.n[2][context] + BACKOFF))
        three[w.begin] = np.log(two[w.begin])  # the word's first character has the edge alone before it
        s = np.add.reduceat(three, w.begin, axis=0)
        admitted = self.admits[w.script]
        return np.where(admitted.any(1)[:, None], np.where(admitted, s, np.float32(-1e4)), np.float32(0))


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word: sum of scores less ``penalty`` for each change,
    texts apart. Exact: blocks of words become max-plus matrices, which chain
    along each text; so texts of any length run vectorised."""
    n, k = scores.shape
    if not n:
        return np.zeros(0, np.int8)
    words = np.diff(first)
    blocks = -(-words // BLOCK)
    begin = np.concatenate([[0], np.cumsum(blocks)])
    nb = int(begin[-1])
    text = np.repeat(np.arange(len(words)), blocks)
    at = first[text] + (np.arange(nb) - begin[text]) * BLOCK
    length = np.minimum(BLOCK, first[text + 1] - at)

    def step(v: np.ndarray, t: int) -> np.ndarray:
        """v: (blocks, ..., k) before word t of each block."""
        live = (length > t).reshape(-1, *[1] * (v.ndim - 1))
        s = scores[np.minimum(at + t, n - 1)].reshape(nb, *[1] * (v.ndim - 2), k)
        return np.where(live, np.maximum(v, v.max(-1, keepdims=True) - penalty) + s, v)

    full = np.where(np.eye(k, dtype=bool), np.float32(0), np.float32(-1e30))[None].repeat(nb, 0)
    for t in range(BLOCK):
        full = step(full, t)
    order = np.argsort(-blocks, kind="stable")
    order = order[blocks[order] > 0]
    left = -np.sort(-blocks[order])
    start, v = np.zeros((nb, k), np.float32), np.zeros((len(order), k), np.float32)
    for i in range(int(left[0])):
        m = int(np.searchsorted(-left, -i, "left"))  # texts of more than i blocks
        b = begin[order[:m]] + i
        start[b] = v[:m] - v[:m].max(1, keepdims=True)
        v[:m] = (start[b][:, :, None] + full[b]).max(1)
    end = v.argmax(1)
    seen = np.empty((BLOCK + 1, nb, k), np.float32)
    seen[0] = start
    for t in range(BLOCK):
        seen[t + 1] = step(seen[t], t)
    path = np.empty((BLOCK, nb, k), np.int8)  # by the block's last label
    now = np.tile(np.arange(k), (nb, 1))
    for t in range(BLOCK - 1, -1, -1):
        path[t] = now
        best = seen[t].argmax(1)[:, None]
        stay = np.take_along_axis(seen[t], now, 1) >= seen[t].max(1, keepdims=True) - penalty
        now = np.where((length > t)[:, None] & ~stay, best, now)
    last = np.zeros(nb, np.int64)
    state = end.copy()
    for i in range(int(left[0]) - 1, -1, -1):
        m = int(np.searchsorted(-left, -i, "left"))
        b = begin[order[:m]] + i
        last[b] = state[:m]
        state[:m] = now[b, state[:m]]
    chosen = path[:, np.arange(nb), last]
    return chosen.T[np.arange(BLOCK)[None, :] < length[:, None]]


def _predict(model: Model, penalty: float, spans: bool, at_text: int, kept: int):
    """Reads the text from column ``at_text``; returns the first ``kept`` columns and the prediction."""
    names = np.array([*model.langs, UND])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.schema.names[at_text], SLICE_BYTES):
                n, k = part.num_rows, len(model.langs)
                lang, score = np.full(n, k), np.zeros(n)
                count, found = np.zeros(n, np.int64), [[] for _ in range(n)]
                w = Words(part.column(at_text))
                if k and len(w.kind):
                    each = model.words(w)[w.kind]
                    path = viterbi(each, w.first, penalty).astype(np.int64)
                    text = np.repeat(np.arange(n), np.diff(w.first))
                    letters = np.bincount(text * k + path, w.letters[w.kind], n * k).reshape(n, k)
                    has = letters.sum(1) > 0
                    lang = np.where(has, letters.argmax(1), k)
                    # words in scripts that no language uses speak for none
                    known = model.admits[w.script].any(1)
                    sure = np.bincount(text * k + path, (w.letters * known)[w.kind], n * k).reshape(n, k)
                    share = sure[np.arange(n), np.minimum(lang, k - 1)] / np.maximum(letters.sum(1), 1)
                    mine = path == lang[text]
                    own = np.stack([np.bincount(text[mine], each[mine, i], n) for i in range(k)], 1)
                    own -= own.max(1, keepdims=True)
                    own = np.exp(own)
                    posterior = own[np.arange(n), np.minimum(lang, k - 1)] / own.sum(1)
                    score = np.where(has, share * posterior, 0.0)
                    new = np.ones(len(path), bool)
                    new[1:] = (path[1:] != path[:-1]) | (text[1:] != text[:-1])
                    head = np.flatnonzero(new)
                    count = np.bincount(text[head], minlength=n)
                    if spans:
                        tail = np.append(head[1:], len(path)) - 1
                        base = Texts(part.column(at_text)).off
                        for i, (a, b) in enumerate(zip(head, tail)):
                            d, o = text[a], int(base[text[a]])
                            s, e = int(w.starts[a]), int(w.ends[b])
                            before = len(w.bytes[o:s].decode("utf-8", "replace"))
                            found[d].append({"start": before, "length": len(w.bytes[s:e].decode("utf-8", "replace")), "lang": str(names[path[a]])})
                columns = [part.column(i) for i in range(kept)]
                columns += [pa.array(names[lang].tolist(), pa.string()), pa.array(score), pa.array(count, pa.int64())]
                fields = [*part.schema.names[:kept], "lang_pred", "score", "n_spans"]
                if spans:
                    columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("lang", pa.string())]))))
                    fields.append("spans")
                yield pa.RecordBatch.from_arrays(columns, fields)
    return run


def learn(documents: DataFrame, training: Column, text_col: str = "text", lang_col: str = "lang",
          sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a hash sample of the ``training`` rows with a label and a text: about
    ``sample_rows`` distinct texts of each language, all if there are fewer, and one at
    least; copies count once."""
    rows = documents.filter(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    place = F.pmod("h", F.lit(1 << 30))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.min(place).alias("first")).collect()  # one row per language
    if not counts:
        return Model([])
    most = {r["lang"]: max(r["first"], int(min(1.0, sample_rows / max(1, r["n"])) * (1 << 30))) for r in counts}
    limit = F.create_map(*[x for k, v in most.items() for x in (F.lit(k), F.lit(v))])
    picked = rows.filter(place <= F.element_at(limit, F.col("lang")))
    picked = picked.groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")
    grams = picked.mapInArrow(_count_ngrams, "lang string, order int, slot int, n long")
    return Model(grams.groupBy("lang", "order", "slot").agg(F.sum("n").alias("n")).collect())


def identify(documents: DataFrame, model: Model, keep: list[str], text_col: str = "text",
             penalty: float = SWITCH_PENALTY, spans: bool = True) -> DataFrame:
    """The ``keep`` columns with lang_pred, score, n_spans and (unless
    ``spans`` is false) spans: start and length in code points, lang. Kept
    columns of those names give way."""
    added = ["lang_pred", "score", "n_spans", *["spans"] * spans]
    keep = [c for c in keep if c.lower() not in added]
    rows = documents.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)])
    if text_col in keep:
        at_text = keep.index(text_col)
    else:
        rows, at_text = documents.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text")), len(keep)
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:len(keep)]]
    schema = ", ".join([*fields, "lang_pred string", "score double", "n_spans long",
                        *["spans array<struct<start:long,length:long,lang:string>>"] * spans])
    return rows.mapInArrow(_predict(model, penalty, spans, at_text, len(keep)), schema).toDF(*keep, *added)


def training_rows(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id) mod 5 is not 0."""
    return fold(doc_id, 5) != 0
