"""The language of texts and of their passages, by a recurrent network over bytes that is trained on the table's own labels."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.gru import ByteGru
from rankloom.llm.token_budget import LANGUAGES, stated_languages
from rankloom.shared import spread

#: Labelled texts of each language from which the network is trained at most, and characters of each.
SAMPLE_TEXTS, SAMPLE_CHARS = 600, 400
WINDOW, EDGE = 96, 8
#: So many neighbouring bytes count as one independent observation.
EVIDENCE = 10
#: Bytes that a passage has at least, unless the text is shorter.
PASSAGE = 24
#: Windows that go through the network at a time; of each only sums by passage stay, so that memory follows the passages of a text and not its bytes.
WINDOWS = 1024

_END = regex.compile(r"\n+|[.!?;](?=\s)|[。！？；]")
_LETTER = regex.compile(r"\p{L}")
_DIGITS = {ord(c): "0" for c in "123456789"}


def plain_case(text: str) -> str:
    """Lower case, digits as 0, blanks as blanks; as many characters as before, and no zero byte."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.translate(_DIGITS).replace("\n", " ").replace("\r", " ").replace("\t", " ").replace("\0", " ")


def without_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def windows_of(data: np.ndarray, length: int = WINDOW, edge: int = EDGE) -> np.ndarray:
    """Windows over a byte array, each overlapping its neighbours by an edge on both sides; zeros before, after and at the end."""
    stride = length - 2 * edge
    n = max(1, -(-len(data) // stride))
    padded = np.zeros(n * stride + 2 * edge, np.uint8)
    padded[edge : edge + len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, length)[::stride][:n]


def passages(text: str) -> list[tuple[int, int]]:
    """Sentences and lines as (start, end) characters; short ones go with the next, a short last one with the one before."""
    cuts = [m.end() for m in _END.finditer(text)]
    out, start = [], 0
    for end in [*cuts, len(text)]:
        if end > start and (len(text[start:end].encode()) >= PASSAGE or end == len(text)):
            out.append((start, end))
            start = end
    if len(out) > 1 and len(text[out[-1][0] : out[-1][1]].encode()) < PASSAGE:
        out[-2:] = [(out[-2][0], out[-1][1])]
    return out


def _shares(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def train(docs: DataFrame, text: str, label: str, key: str, languages: list[str] = LANGUAGES, sample: int = SAMPLE_TEXTS, seed: int = 11) -> ByteGru | None:
    """A network from at most ``sample`` texts per language whose label states that language alone, chosen by a hash of their key.
    None if no language has a labelled text. Labels may be wrong now and then: see ByteGru.train."""
    stated = docs.select(F.col(key).alias("key"), stated_languages(F.col(label)).alias("l"), F.col(text).alias("text"))
    stated = stated.filter((F.size("l") == 1) & F.col("l")[0].isin(languages) & F.col("text").rlike(r"\p{L}"))
    at = F.pmod(F.xxhash64(F.lit("at"), "key"), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS)).cast("int") + 1
    rows = stated.select(F.col("l")[0].alias("lang"), F.xxhash64(F.lit(seed), "key").alias("h"), F.col("text").substr(at, F.lit(SAMPLE_CHARS)).alias("text"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("n") <= sample)
    picked = sorted(map(tuple, rows.select("lang", "h", "text").collect()))  # bounded by sample * languages
    if not picked:
        return None
    rng = np.random.default_rng(seed)
    x, y = [], []
    for lang, _, body in picked:
        body = plain_case(body)
        if not _LETTER.search(body):
            continue
        if rng.random() < 0.35:
            body = without_accents(body)
        x.append(np.frombuffer(body.encode(), np.uint8))
        y.append(languages.index(lang))
    if not x:
        return None
    texts = np.zeros((len(x), max(map(len, x)) + 2 * EDGE), np.uint8)
    for i, data in enumerate(x):
        texts[i, EDGE : EDGE + len(data)] = data
    return ByteGru(len(languages)).train(texts, np.array(y))


def joined(found: list, more: list) -> list:
    """Passages in order, neighbours of one language as one; their confidence is the mean by length."""
    found = list(found)
    for a, b, lang, c in more:
        if found and found[-1][2] == lang:
            a0, b0, _, c0 = found[-1]
            found[-1] = (a0, b, lang, (c0 * (b0 - a0) + c * (b - a)) / (b - a0))
        else:
            found.append((a, b, lang, c))
    return found


class Labeller:
    def __init__(self, net: ByteGru, languages: list[str]):
        self.net, self.languages = net, languages

    def __call__(self, texts: list[str]) -> list[list[tuple[int, int, str | None, float]]]:
        """Of each text its passages: (start, end, language or None, confidence), in characters; neighbours of one language are one passage. Texts of any length are labelled whole."""
        plain = [plain_case(t) for t in texts]
        data = [np.frombuffer(p.encode(), np.uint8) for p in plain]
        views = [windows_of(d) for d in data]
        stride = WINDOW - 2 * EDGE
        first = np.cumsum([0, *[len(v) for v in views]])
        every = np.concatenate(views) if views else np.zeros((0, WINDOW), np.uint8)
        # Bytes stand one after another, a text's windows side by side; a passage begins at one of them, and so does what fills up a text's last window.
        cuts = [passages(t) for t in texts]
        places, begins = [], []
        for i, cut in enumerate(cuts):
            where = np.append(np.flatnonzero((data[i] & 0xC0) != 0x80), len(data[i]))
            starts = np.append(where[[a for a, _ in cut]], len(data[i])) if cut else np.array([len(data[i])])
            places.append(starts)
            begins.append(starts + first[i] * stride)
        begin = np.concatenate([*begins, [len(every) * stride]]) if begins else np.zeros(1, np.int64)
        sums = np.zeros((len(begin), len(self.languages)))
        for at in range(0, len(every), WINDOWS):
            logs = self.net.log_probabilities(every[at : at + WINDOWS])[:, EDGE : WINDOW - EDGE].reshape(-1, len(self.languages))
            low, high = at * stride, at * stride + len(logs)
            a, b = np.searchsorted(begin, low, "right") - 1, np.searchsorted(begin, high, "left")
            local = np.maximum(begin[a:b] - low, 0)
            held = np.flatnonzero(np.diff(np.append(local, len(logs))) > 0)
            sums[a + held] += np.add.reduceat(logs, local[held], axis=0)
        out, row = [], 0
        for i, t in enumerate(texts):
            cut, starts = cuts[i], places[i]
            mine, row = sums[row : row + len(cut)], row + len(cut) + 1
            if not cut:
                out.append([])
                continue
            sizes = np.diff(starts)
            mean = mine / sizes[:, None]
            # The document's languages, pooled over its bytes, decide between those that a short passage leaves open.
            own = _shares(mean)
            pooled = (own * sizes[:, None]).sum(0) / sizes.sum()
            judged = _shares(mean * (sizes / EVIDENCE)[:, None] + np.log(0.02 + 0.98 * pooled))
            best = judged.argmax(1)
            p = judged.max(1)
            each = []
            for (a, b), k, c in zip(cut, best, p, strict=True):
                lang = self.languages[k] if _LETTER.search(t, a, b) else None
                each.append((a, b, lang, float(c) if lang else 0.0))
            out.append(joined([], each))
        return out


def segments(docs: DataFrame, key: str, text: str, label: str, languages: list[str] = LANGUAGES, sample: int = SAMPLE_TEXTS) -> DataFrame:
    """key, start, end (characters, from 0), chars, language (null where a passage has no letters), confidence.

    The network is trained once from a bounded sample of labelled rows; then every byte of every text is labelled, passage by passage the log probabilities are
    averaged, and neighbouring passages of one language are joined. Null and empty texts give no rows, rows without key are dropped, rows with equal
    keys are labelled each. Without any labelled row there is no network and no result. Texts are dealt evenly to all tasks, which costs
    a hundredth of labelling them.
    """
    rows = docs.filter(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, start bigint, end bigint, chars bigint, language string, confidence double, text_chars bigint"
    net = train(docs.select(key, text, label), text, label, key, languages, sample)
    if net is None:
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(net, languages)
        for batch in batches:
            # As many texts at a time as make up about a megabyte.
            at = 0
            sizes = batch["text"].str.len().to_numpy().cumsum()
            while at < len(batch):
                done = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, done + 400_000)))
                part = batch.iloc[at:end]
                out = [(k, a, b, b - a, lang, c, len(t)) for k, t, found in zip(part["key"], part["text"], labeller(part["text"].tolist()), strict=True) for a, b, lang, c in found]
                yield pd.DataFrame(out, columns=["key", "start", "end", "chars", "language", "confidence", "text_chars"])
                at = end

    return spread(rows).mapInPandas(each, schema).withColumnRenamed("key", key)


def shares(passages_: DataFrame, key: str) -> DataFrame:
    """key, language, share (of all characters of the text), confidence: one row per text and language found in it."""
    mean = F.sum(F.col("confidence") * F.col("chars")) / F.sum("chars")
    found = passages_.filter("language is not null").groupBy(key, "language").agg((F.sum("chars") / F.max("text_chars")).alias("share"), mean.alias("confidence"))
    return found


def unstated(docs: DataFrame, found: DataFrame, key: str, label: str, least: float = 0.2) -> DataFrame:
    """key, lang_found: languages of at least the share ``least`` of a text that its label does not state."""
    labels = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), stated_languages(F.col(label)).alias("_l"))
    large = found.filter(F.col("share") >= least)
    out = large.join(labels, large[key] == labels["_k"]).filter(~F.array_contains("_l", F.col("language")))
    return out.select(key, F.col("language").alias("lang_found")).distinct()
