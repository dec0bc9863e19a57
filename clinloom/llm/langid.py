"""Language identification with a byte convolutional network.

Filters of several widths slide over one-hot bytes of a fixed-length window; each
filter's largest response in the window, rectified, feeds a softmax over languages.
The network is trained in numpy on labelled text and applied to all windows of a
whole text; the windows of many texts go through the network together, in batches of a
fixed size. A text's language has the highest mean probability over its windows (weighted
by their letters' bytes), and that mean is the score.

Defined cases: a text that is null or has no letter is `und` with score 0; very long
texts are taken window by window; ties go to the language that sorts first; repeated
rows are judged each for itself; other columns pass through, but for lang_pred and
score, which are replaced. Rows without label or text take no part in training; with
no such row at all every text is `und`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinloom.llm.common import in_bounded_batches, kept, quoted, table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: The training sample: at most this many windows of each language, and about as many of all languages together. Every labelled language is learned.
WINDOWS_PER_LANG = 3000
WINDOWS_IN_ALL = 600_000
#: Windows in a batch, whatever texts they come from.
BATCH = 4096
LETTER = regex.compile(r"\p{L}")


class ByteCnn:
    """Weights: by width w a table (w, 256, FILTERS) of responses, then a softmax layer."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.conv = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def features(self, x: np.ndarray, places: bool = False):
        """Pooled responses of windows x (n, WINDOW) of bytes; on request also where each was largest."""
        feats, at = [], []
        for w, table_, bias in zip(WIDTHS, self.conv, self.bias):
            m = x.shape[1] - w + 1
            r = table_[0][x[:, :m]]
            for j in range(1, w):
                r += table_[j][x[:, j : j + m]]
            if places:
                p = r.argmax(axis=1)
                at.append(p)
                top = np.take_along_axis(r, p[:, None, :], axis=1)[:, 0]
            else:
                top = r.max(axis=1)
            feats.append(np.maximum(top + bias, 0))
        f = np.concatenate(feats, axis=1)
        return (f, at) if places else f

    @staticmethod
    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray, step: int = 16) -> np.ndarray:
        """step: windows at a time, few enough for the processor's cache."""
        return np.concatenate([self.softmax(self.features(x[i : i + step]) @ self.out + self.out_bias) for i in range(0, len(x), step)]) if len(x) else np.empty((0, len(self.langs)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteCnn:
        """Adam on the cross entropy; pooling sends each filter's gradient to one place of the window."""
        rng = np.random.default_rng(seed)
        params = [*self.conv, *self.bias, self.out, self.out_bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            lr = rate * (0.5 ** (epoch // 2))
            for i in range(0, len(x), batch):
                part = order[i : i + batch]
                xb, t = x[part], t + 1
                f, at = self.features(xb, places=True)
                g = self.softmax(f @ self.out + self.out_bias)
                g[np.arange(len(part)), y[part]] -= 1
                g /= len(part)
                gf = (g @ self.out.T) * (f > 0)
                grads = []
                for k, w in enumerate(WIDTHS):
                    gk, d = gf[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(self.conv[k])
                    for j in range(w):
                        np.add.at(d[j], (xb[np.arange(len(part))[:, None], at[k] + j], np.arange(FILTERS)[None, :]), gk)
                    grads.append(d)
                grads += [gf[:, k * FILTERS : (k + 1) * FILTERS].sum(axis=0) for k in range(len(WIDTHS))]
                grads += [f.T @ g, g.sum(axis=0)]
                for p, d, a, b in zip(params, grads, m, v):
                    a += 0.1 * (d - a)
                    b += 0.001 * (d * d - b)
                    p -= lr * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        return self


def windows(text: str) -> np.ndarray:
    """All windows of a whole text, the last filled with zero bytes; they overlap by a filter's width less one."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    step = WINDOW - max(WIDTHS) + 1
    n = max(1, -(-(len(data) - max(WIDTHS) + 1) // step))
    full = np.zeros((n - 1) * step + WINDOW, dtype=np.uint8)
    full[: len(data)] = data[: len(full)]
    return np.lib.stride_tricks.as_strided(full, (n, WINDOW), (step, 1))


def train(df: DataFrame, text: str = "text", lang: str = "lang", row_hash: str = "_h", per_lang: int = WINDOWS_PER_LANG, seed: int = 7) -> ByteCnn | None:
    """A network fitted on at most per_lang windows of each language, spread over all labelled texts by row_hash.

    Windows stand anywhere in a text. row_hash: a column of whole numbers that decides, with
    nothing else, which rows and windows are taken; it is no input of the network.
    """
    known = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = {r[lang]: r["n"] for r in known.groupBy(lang).agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return None
    langs = sorted(counts)
    per_lang = max(1, min(per_lang, WINDOWS_IN_ALL // len(langs)))
    # in the plan itself: a join would deal the texts by language
    share = F.create_map(*[F.lit(v) for k in langs for v in (k, min(1.0, 1.3 * per_lang / (4 * counts[k]) + 20 / counts[k]))])
    draw = F.pmod(F.xxhash64(row_hash, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = known.where(draw < F.element_at(share, F.col(lang))).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(row_hash, F.lit(seed + 1)).alias("h"))

    def cut(batches):
        for b in in_bounded_batches(batches):
            got = {"lang": [], "h": [], "w": []}
            for la, te, h in zip(*(c.to_pylist() for c in b.columns)):
                w = windows(te)
                rng = np.random.default_rng(h & (2**63 - 1))
                take = rng.choice(len(w), min(8 if len(w) > 8 else 4, len(w)), replace=False)
                got["lang"] += [la] * len(take)
                got["h"] += rng.integers(0, 2**62, len(take)).tolist()
                got["w"] += [w[i].tobytes() for i in take]
            yield pa.RecordBatch.from_pydict(got, schema=pa.schema([("lang", pa.string()), ("h", pa.int64()), ("w", pa.binary())]))

    sample = picked.mapInArrow(cut, "lang string, h long, w binary").orderBy("h").limit(per_lang * len(langs)).toPandas()
    x = np.frombuffer(b"".join(sample["w"]), dtype=np.uint8).reshape(-1, WINDOW).copy()
    y = sample["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy()
    short = np.random.default_rng(seed).random(len(x)) < 0.3  # short texts occur too
    for i in np.flatnonzero(short):
        x[i, np.random.default_rng(i).integers(24, WINDOW) :] = 0
    return ByteCnn(langs, seed).fit(x, y, seed=seed)


def predict_texts(model: ByteCnn | None, texts: list[str | None], batch: int = BATCH) -> list[tuple[str, float]]:
    """Language and score of each whole text; windows of all texts share the batches."""
    n = len(texts)
    if model is None:
        return [("und", 0.0)] * n
    total, weight = np.zeros((n, len(model.langs))), np.zeros(n)
    wait: list[np.ndarray] = []
    owner: list[np.ndarray] = []

    def flush() -> None:
        x, of = np.concatenate(wait), np.concatenate(owner)
        wait.clear()
        owner.clear()
        # the share of a window that may be letters: a to z, A to Z and all beyond ASCII
        low = x | 0x20
        mass = (((low >= 97) & (low <= 122)) | (x >= 128)).sum(axis=1) + 1e-3
        np.add.at(total, of, model.probabilities(x) * mass[:, None])
        np.add.at(weight, of, mass)

    have = 0
    for i, text in enumerate(texts):
        if not text or not LETTER.search(text):
            continue
        w = windows(text)
        for lo in range(0, len(w), batch):
            part = w[lo : lo + batch]
            wait.append(np.ascontiguousarray(part))
            owner.append(np.full(len(part), i))
            have += len(part)
            if have >= batch:
                flush()
                have = 0
    if wait:
        flush()
    out = []
    for i in range(n):
        if not weight[i]:
            out.append(("und", 0.0))
            continue
        p = total[i] / weight[i]
        k = int(p.argmax())
        out.append((model.langs[k], float(min(1.0, max(0.0, p[k])))))
    return out


def identify(df: DataFrame, model: ByteCnn | None, text: str = "text", row: str | None = None) -> DataFrame:
    """Adds lang_pred and score, from the text alone. row: the struct that holds the text, if it is no column of its own."""
    df = df.drop("lang_pred", "score")
    shared = df.sparkSession.sparkContext.broadcast(model)  # fixed size: tables of 256 bytes by width and filter
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        kept("langid")
        for b in in_bounded_batches(batches):
            texts = b.column(row).field(text) if row else b.column(text)
            got = predict_texts(shared.value, texts.to_pylist())
            cols = [*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "lang_pred", "score"])

    return df.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = docs.where(~held_out()).withColumn("_h", F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")))
    model = train(learn)
    out = identify(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


#: The pipeline rejects what has no language and what no language explains with at least this probability.
MIN_SCORE = 0.35


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language. Null, empty and letterless texts go; repeated rows are judged alike; with no labelled text no row has a language; columns are those of docs."""
    learn = docs.select("text", "lang", F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")).alias("_h"))
    # a text goes to the workers and back once, within its row
    judged = identify(docs.select(F.struct(*map(quoted, docs.columns)).alias("row")), train(learn), row="row")
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select("row.*")


QUERIES = {"op1_language_id": op1_language_id}
ORACLE_SQL: dict[str, str] = {}
