"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

Two dictionaries hold text of either label. A text is cut into blocks of BLOCK bytes, so short that text which repeats
itself gains nothing from that and only the dictionaries tell blocks apart, and each block is compressed with either one. The
normalised difference of the two sizes, (bad - good) / (bad + good), is taken for each block and for their sums; its mean,
extremes and deviation over the blocks and the difference of the sums go through a logistic regression, and isotonic
regression turns that margin into the probability of label 1. Dictionaries, weights and curve are fitted on separate
labelled rows. Labels are the only thing learnt from; id, language and source are never inputs.

Defined results: a null or empty text scores the share of good rows in the sample's labels; labels other than 0 and 1
are ignored; without labelled rows of both kinds every score is 0.5; equal texts, so repeated rows too, get equal scores; a very
long text is scored whole, in blocks; an input column that has the score's name is replaced; no rows give no rows.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, ship
from .learn import Isotonic, Logistic, label_weights, remainder, sample

DICTIONARY_BYTES = 112_640
BLOCK = 64
SLICE = 128
LEVEL = 3
THRESHOLD = 0.3


class Model:
    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad, self.margin, self.curve, self.prior = good, bad, None, None, 0.5

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "made"}

    def _compressors(self):
        if "made" not in self.__dict__:
            import zstandard as z

            self.made = []
            for raw in (self.good, self.bad):
                d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self.made.append(z.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
        return self.made

    def sizes(self, text: str) -> np.ndarray:
        """A row for each block: its compressed sizes with the good and with the bad dictionary. A rest of less than a quarter
        block goes with the block before it."""
        raw, (good, bad) = text.encode(), self._compressors()
        edges = [*range(0, len(raw), BLOCK), len(raw)]
        if len(edges) > 2 and edges[-1] - edges[-2] < BLOCK // 4:
            edges.pop(-2)
        return np.array([(len(good.compress(raw[a:b])), len(bad.compress(raw[a:b]))) for a, b in pairwise(edges)], float).reshape(-1, 2)

    def features(self, text: str) -> np.ndarray:
        """The normalised difference of the sizes: mean, least, greatest, deviation over the blocks, and that of the sums."""
        size = self.sizes(text)
        if not len(size):
            return np.zeros(5)
        d = (size[:, 1] - size[:, 0]) / size.sum(1)
        good, bad = size.sum(0)
        return np.array([d.mean(), d.min(), d.max(), d.std(), (bad - good) / (bad + good)])

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.curve is None or not texts:
            return np.full(len(texts), 0.5)
        out = self.curve(self.margin(np.array([self.features(t) for t in texts])))
        out[[i for i, t in enumerate(texts) if not t]] = self.prior
        return out


def _content(texts: list[str]) -> bytes:
    """A slice from the middle of one text after the other, up to the dictionary's size."""
    raw, n = [], 0
    for t in texts:
        b = t.encode()
        lo = max(0, (len(b) - SLICE) // 2)
        raw.append(b[lo : lo + SLICE])
        n += len(raw[-1]) + 1
        if n >= DICTIONARY_BYTES:
            break
    return b"\n".join(raw)[:DICTIONARY_BYTES]


def fit(rows, share: float | None = None) -> Model:
    """From a frame (doc_id, text, y) and the share of good rows among all labels. Half of the rows give the dictionaries, a third
    the weights, a sixth the curve."""
    rows = rows[rows["text"].str.len() > 0]
    part = np.arange(len(rows)) % 6
    dic, grow, cal = rows[part < 3], rows[(part == 3) | (part == 4)], rows[part == 5]
    model = Model(_content(dic["text"][dic["y"] == 1].tolist()), _content(dic["text"][dic["y"] == 0].tolist()))
    if len(model.good) > 8 and len(model.bad) > 8 and grow["y"].nunique() == 2 and cal["y"].nunique() == 2:
        x, y, z = np.array([model.features(t) for t in grow["text"]]), grow["y"].to_numpy().astype(float), cal["y"].to_numpy().astype(float)
        model.margin = Logistic(x, y, label_weights(y, share))
        model.curve = Isotonic(model.margin(np.array([model.features(t) for t in cal["text"]])), z, label_weights(z, share))
        model.prior = float(rows["y"].mean()) if share is None else share
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", into: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score in the column ``into``."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(into)
    at = docs.columns.index(text_col)
    schema = docs.withColumn(into, F.lit(0.0)).schema
    names = schema.fieldNames()

    def run(batches):
        for batch in batches:
            for off in range(0, batch.num_rows, 256):
                part = batch.slice(off, 256)
                s = shared.value.scores([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], names=names)

    return docs.mapInArrow(run, schema)


def op5_quality(spark, sf_dir, modulus: int = 5, held: int = 0):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(*sample(docs, read(spark, sf_dir, "labels"), "quality", remainder(F.col("doc_id"), modulus) != held))
    out = score(docs, model).drop("text")
    return out.select("doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
