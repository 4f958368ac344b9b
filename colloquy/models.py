"""Models as replaceable functions with deterministic defaults.

A speech or language model is a Column -> Column function registered by kind and
name.  The defaults need no weights: an embedding is a hashed bag of words, a
transcription a placeholder, a signal's embedding its plain statistics.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .functions.text import persons

_REGISTRY: dict[tuple[str, str], Callable[..., Column]] = {}
#: Fixed value: the size of a speaker vector.
DIMENSIONS = 192


def register(kind: str, name: str, f: Callable[..., Column]) -> None:
    _REGISTRY[kind, name] = f


def get(kind: str, *names: str) -> Callable[..., Column]:
    """The first of the names that is registered, else the kind's default."""
    for n in (*names, "default"):
        if (kind, n) in _REGISTRY:
            return _REGISTRY[kind, n]
    raise KeyError(f"no model of kind {kind}")


def hashed_bag(text: Column, size: int = 64) -> Column:
    """Words hashed into ``size`` places with signs, scaled to length 1; inside the JVM."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+"), lambda w: w != "")
    hits = F.transform(words, lambda w: F.xxhash64(w))
    v = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(hits, F.lit(0.0), lambda s, h: s + F.when(F.pmod(h, F.lit(size)) == i, F.when(h > 0, 1.0).otherwise(-1.0)).otherwise(0.0)))
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


@F.pandas_udf(ArrayType(DoubleType()))
def bag_embedding(text: pd.Series) -> pd.Series:
    """As ``hashed_bag``, whole batches at a time, with hashes of its own: words hashed into 64 places with signs, length 1."""
    import regex
    import xxhash

    known: dict[str, tuple[int, float]] = {}

    def one(t: str | None) -> list[float]:
        v = np.zeros(64)
        for w in regex.findall(r"[\p{L}\p{M}\p{N}_]+", (t or "").lower()):
            if w not in known:
                h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))
                known[w] = (h & 63, 1.0 if h >> 63 else -1.0)
            place, sign = known[w]
            v[place] += sign
        n = np.linalg.norm(v)
        return (v / n if n > 0 else v).tolist()

    return text.map(one, na_action=None)


def signal_vector(samples: np.ndarray, rate: int, size: int = DIMENSIONS) -> np.ndarray:
    """Mean, standard deviation and spectral centre of a window, padded, scaled to length 1."""
    out = np.zeros(size)
    if len(samples):
        spectrum = np.abs(np.fft.rfft(samples))
        total = spectrum.sum()
        centre = (np.fft.rfftfreq(len(samples), 1 / rate) * spectrum).sum() / total / (rate / 2) if total > 0 else 0.0
        out[:3] = samples.mean(), samples.std(), centre
    return out / (np.linalg.norm(out) + 1e-12)


@F.pandas_udf(ArrayType(DoubleType()))
def signal_embedding(samples: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series([signal_vector(np.asarray(x, float), int(r)).tolist() for x, r in zip(samples, rate)])


def placeholder_transcript(start: Column, end: Column) -> Column:
    return F.format_string("[Transkripsi %.1f-%.1f]", start, end)


def hash_vector(key: str, size: int = DIMENSIONS) -> list[float]:
    """What stands in for a vector that could not be made: fixed by the key."""
    v = np.random.default_rng(zlib.crc32(key.encode())).standard_normal(size)
    return (v / np.linalg.norm(v)).tolist()


#: What this process has loaded, by name; Spark keeps Python workers from task to task, so a model is loaded once in each.
_HELD: dict[str, object] = {}


def held(name: str, load: Callable[[], object]) -> object:
    if name not in _HELD:
        _HELD[name] = load()
    return _HELD[name]


def column_model(name: str, load: Callable[[], object], apply: Callable[[object, pd.Series], pd.Series], returns) -> Callable[[Column], Column]:
    """A Column -> Column function over a model that each worker loads once, however many tasks and batches it runs.

    Give it to ``register``; two models need two names.  ``load`` runs on the executors and must find its files there.
    """
    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = held(name, load)
        for batch in batches:
            yield apply(model, batch)

    return run


def map_model(rows: DataFrame, name: str, load: Callable[[], object], apply: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str, profile: ResourceProfile | None = None) -> DataFrame:
    """Batches of rows through a model that each worker loads once; ``profile`` asks for what its stage needs (accelerators, memory)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held(name, load)
        for batch in batches:
            yield apply(model, batch)

    return rows.mapInPandas(run, schema, profile=profile)


def mel_coefficients(samples: np.ndarray, rate: int, count: int = 20, window: float = 0.025, hop: float = 0.01, bands: int = 26) -> np.ndarray:
    """Cepstral coefficients by frame: windowed power spectrum, triangular mel bands, logarithm, cosine transform."""
    size, step = max(2, int(window * rate)), max(1, int(hop * rate))
    x = np.pad(np.asarray(samples, float), (0, max(0, size - len(samples))))
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::step] * np.hamming(size)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2 / size
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), bands + 2)
    at = np.floor((size + 1) * 700 * (10 ** (mel / 2595) - 1) / rate)
    k = np.arange(power.shape[1])
    up, down = ((k - at[:-2, None]) / np.maximum(at[1:-1] - at[:-2], 1)[:, None], (at[2:, None] - k) / np.maximum(at[2:] - at[1:-1], 1)[:, None])
    bank = np.log(power @ np.maximum(0, np.minimum(up, down)).T + 1e-10)
    return bank @ np.cos(np.pi / bands * np.outer(np.arange(bands) + 0.5, np.arange(count)))


def mel_vector(samples: np.ndarray, rate: int, size: int = DIMENSIONS) -> np.ndarray:
    """Means and deviations of the cepstral coefficients and of their changes, padded, scaled to length 1."""
    out = np.zeros(size)
    if len(samples):
        c = mel_coefficients(samples, rate)
        change = np.diff(c, axis=0) if len(c) > 1 else np.zeros_like(c)
        parts = np.concatenate([c.mean(0), c.std(0), change.mean(0), change.std(0)])[:size]
        out[: len(parts)] = parts
    return out / (np.linalg.norm(out) + 1e-12)


@F.pandas_udf(ArrayType(DoubleType()))
def mel_embedding(samples: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series([mel_vector(np.asarray(x, float), int(r)).tolist() for x, r in zip(samples, rate)])


def greedy_tokens(best: Column, blank: int = 0) -> Column:
    """Connectionist decoding of the best token of each frame: repeats collapse, then blanks go."""
    kept = F.filter(F.transform(best, lambda t, i: F.struct(t.alias("t"), ((i == 0) | (F.get(best, i - 1) != t)).alias("new"))), lambda r: r["new"] & (r["t"] != blank))
    return F.transform(kept, lambda r: r["t"])


def _best_prefix(frames: np.ndarray, width: int, blank: int) -> tuple[list[int], float]:
    """The likeliest token sequence of log probabilities (frame, token), and its log probability.

    A prefix carries the mass of its paths that end in the blank and of those that end in its last token; paths that
    read the same are one prefix.  After each frame the ``width`` likeliest stay, ties by the smaller tokens.
    """
    beam: dict[tuple[int, ...], tuple[float, float]] = {(): (0.0, -np.inf)}
    for frame in frames:
        grown: dict[tuple[int, ...], list[float]] = {}
        for prefix, (silent, voiced) in beam.items():
            both = np.logaddexp(silent, voiced)
            own = grown.setdefault(prefix, [-np.inf, -np.inf])
            own[0] = np.logaddexp(own[0], both + frame[blank])
            for token, p in enumerate(frame):
                if token == blank or p == -np.inf:
                    continue
                again = bool(prefix) and prefix[-1] == token
                if again:
                    own[1] = np.logaddexp(own[1], voiced + p)
                longer = grown.setdefault((*prefix, token), [-np.inf, -np.inf])
                longer[1] = np.logaddexp(longer[1], (silent if again else both) + p)
        kept = sorted(grown.items(), key=lambda e: (-np.logaddexp(*e[1]), e[0]))[:width]
        beam = {prefix: (silent, voiced) for prefix, (silent, voiced) in kept}
    prefix, mass = min(beam.items(), key=lambda e: (-np.logaddexp(*e[1]), e[0]))
    return list(prefix), float(np.logaddexp(*mass))


def beam_tokens(frames: Column, width: int = 16, blank: int = 0) -> Column:
    """Connectionist decoding by prefixes: ``tokens`` and ``score`` of an array of frames, each the tokens' log probabilities; null stays null."""
    fields = StructType([StructField("tokens", ArrayType(IntegerType())), StructField("score", DoubleType())])

    @F.pandas_udf(fields)
    def run(utterances: pd.Series) -> pd.DataFrame:
        found = [(None, None) if u is None else _best_prefix(np.array([np.asarray(f, float) for f in u]), width, blank) for u in utterances]
        return pd.DataFrame(found, columns=["tokens", "score"])

    return F.when(frames.isNotNull(), run(frames))


def transcribe_segments(segments, text: str = "text", model: str = "default", least: float = 0.3):
    """Segments (start, end) of ``least`` seconds or more with the text that the registered model gives them."""
    long = segments.where(F.col("end") - F.col("start") >= least)
    return long.withColumn(text, get("transcription", model)(F.col("start"), F.col("end")))


def embed_windows(windows, model: str = "mel", vec: str = "embedding"):
    """Windows (samples, sample_rate) with a vector each; a fixed vector by ``key`` stands in where there are no samples."""
    given = get("signal_embedding", model)(F.col("samples"), F.col("sample_rate"))
    return windows.withColumn(vec, F.when(F.size("samples") > 0, given).otherwise(_stand_in(F.col("key"))))


@F.pandas_udf(ArrayType(DoubleType()))
def _stand_in(key: pd.Series) -> pd.Series:
    return key.map(lambda k: hash_vector(str(k)))


def refine(overview: Column, model: str = "default") -> Column:
    """A registered abstractive model's wording; the default leaves the text as it is."""
    return get("abstractive", model)(overview)


def named_persons(text: Column, model: str = "default") -> Column:
    """Persons by a registered recogniser; by capitalised words by default."""
    return get("persons", model)(text)


def detect_language(text: Column) -> Column:
    """A vote of common words: id or en."""
    low = F.lower(F.coalesce(text, F.lit("")))
    count = lambda ws: F.regexp_count(low, F.lit(rf"\b(?:{'|'.join(ws)})\b"))
    return F.when(count(["the", "and", "is", "of", "to"]) > count(["yang", "dan", "di", "ini", "itu"]), "en").otherwise("id")


register("sentence_embedding", "default", bag_embedding)
register("sentence_embedding", "columns", hashed_bag)
register("signal_embedding", "default", signal_embedding)
register("transcription", "default", placeholder_transcript)
register("signal_embedding", "mel", mel_embedding)
register("abstractive", "default", lambda text: text)
register("persons", "default", persons)
register("language", "default", detect_language)
