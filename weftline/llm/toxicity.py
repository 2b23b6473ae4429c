"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learnt from labelled rows: words, and beginnings of words of 4 and 5 letters, that are far more frequent
in toxic texts. Each text gives densities of lexicon words (as written, by their beginnings, and after digits and signs
inside words are read as letters), how many different ones there are, how near they stand to a second-person word,
shares of capitals and of exclamation and other signs, and rates of obfuscated words. Trees and curve see each half of the
labelled sample with the lexicon of the other half; the curve's third gives nothing to the trees. Labels are the only thing
learnt from; id, language and source are never inputs.

Defined results: a null or empty text has features of 0 and the score they give; labels other than 0 and 1 are ignored;
without labelled rows of both kinds every score is 0.5; equal texts, so repeated rows too, get equal scores; a null id
keeps its row; very long texts are read whole; other columns, whatever their names, are ignored; no rows give no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, ship
from .learn import Boosted, Isotonic, label_weights, remainder, sample, without_copies

THRESHOLD = 0.3
LEXICON_WORDS = 4000
NEAR = 4
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»„“”’…"
#: Second-person words of the languages at hand.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split())
#: Signs and digits read as letters.
LOOKS = str.maketrans("013457@$!|", "oleastasil")
INNER = re.compile(r"[^\W\d_][^\w\s]+[^\W\d_]|[^\W\d_]\d+[^\W\d_]|[^\W\d_][@$|*]+|[@$]+[^\W\d_]")
SPACED = re.compile(r"(?:(?<=\s)|^)(?:\w[ .\-_*]){3,}\w(?=\s|$|[!?.,])")
LETTERS = re.compile(r"[^a-zß-ÿœ]")
ODD = re.compile(r"[0-9@$!|*._\-]")


def plain(word: str) -> str:
    """A word with digits and signs read as letters and everything else dropped."""
    return LETTERS.sub("", word.translate(LOOKS))


class Model:
    def __init__(self, words: dict[str, float], heads: dict[str, float]):
        self.words, self.heads, self.trees, self.curve = words, heads, None, None

    def features(self, text: str) -> list[float]:
        words, heads = self.words, self.heads
        low = text.lower().split()
        n = len(low)
        hit, seen, near, odd, hidden, by_head, weight = 0, set(), 0, 0, 0, 0, 0.0
        places = []
        for i, w in enumerate(low):
            w = w.strip(SIGNS)
            if w in words:
                hit += 1
                weight += words[w]
            elif w[:5] in heads or w[:4] in heads:
                by_head += 1
                weight += heads.get(w[:5]) or heads.get(w[:4])
            elif ODD.search(w):
                p = plain(w)
                if p == w:
                    continue
                odd += 1
                if p in words or p[:5] in heads:
                    hidden += 1
                else:
                    continue
            else:
                continue
            seen.add(w)
            places.append(i)
        for i in places:
            near += any(x.strip(SIGNS) in SECOND for x in low[max(0, i - NEAR) : i + NEAR + 1])
        for m in SPACED.finditer(text.lower()):
            p = plain(m.group())
            hidden += p in words or p[:5] in heads
        size = max(1, len(text))
        caps = sum(map(str.isupper, text)) / size if not text.islower() else 0.0
        signs = sum(map(text.count, "!?")) / size
        k = max(1, n)
        all_hits = hit + by_head + hidden
        return [hit / k, by_head / k, hidden / k, np.log1p(hit), np.log1p(by_head), np.log1p(hidden), len(seen) / k, np.log1p(len(seen)), np.log1p(weight), near / k, all_hits / k, odd / k, caps, signs, np.log1p(n)]

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.curve is None or not texts:
            return np.full(len(texts), 0.5)
        return self.curve(self.trees(np.array([self.features(t) for t in texts], float)))


def learn_lexicon(texts: list[str], y: np.ndarray, most: int = LEXICON_WORDS) -> tuple[dict, dict]:
    bad, good, bad_h, good_h = Counter(), Counter(), Counter(), Counter()
    for t, k in zip(texts, y, strict=True):
        own = {w.strip(SIGNS) for w in t.lower().split()}
        heads = {w[:n] for w in own for n in (4, 5) if len(w) > n}
        (bad if k else good).update(own)
        (bad_h if k else good_h).update(heads)
    nb, ng = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))

    def pick(b, g, least):
        least = max(2, min(least, -(-nb * least // 150)))
        odds = {w: float(np.log((c + 0.5) / nb) - np.log((g[w] + 0.5) / ng)) for w, c in b.items() if w and c >= least}
        return dict(sorted(((w, o) for w, o in odds.items() if o > 2.5), key=lambda x: (-x[1], x[0]))[:most])

    return pick(bad, good, 6), pick(bad_h, good_h, 10)


def fit(rows, share: float | None = None) -> Model:
    """From a frame (doc_id, text, y); ``share`` is the share of toxic rows among all labels."""
    rows = without_copies(rows)
    if rows["y"].nunique() < 2 or len(rows) < 12:
        return Model({}, {})
    texts, y = rows["text"].tolist(), rows["y"].to_numpy().astype(float)
    half = np.arange(len(rows)) % 2 == 0
    x = np.zeros((len(rows), len(Model({}, {}).features(""))))
    for own in (half, ~half):  # each half is seen with the lexicon of the other
        other = Model(*learn_lexicon([t for t, k in zip(texts, own, strict=True) if not k], y[~own]))
        x[own] = [other.features(t) for t, k in zip(texts, own, strict=True) if k]
    model = Model(*learn_lexicon(texts, y))
    weight = label_weights(y, share)
    third = np.arange(len(rows)) % 3 == 0
    model.trees = Boosted(x[~third], y[~third], weight[~third], least=max(2.0, min(8.0, len(rows) / 100)))
    model.curve = Isotonic(model.trees(x[third]), y[third], weight[third])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for off in range(0, batch.num_rows, 256):
                part = batch.slice(off, 256)
                s = shared.value.scores([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def op6_toxicity(spark, sf_dir, modulus: int = 4, held: int = 2):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(*sample(docs, read(spark, sf_dir, "labels"), "toxic", remainder(F.col("doc_id"), modulus) != held))
    out = score(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
