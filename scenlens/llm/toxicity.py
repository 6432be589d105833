"""Toxicity by compression distance: windows of a text against dictionaries of toxic and of ordinary text.

1. A word is coded by two bytes a byte, a hash of the word up to there: words match as far as they begin alike, and what
   does not match costs its whole length, as nothing but dictionaries can compress it.
2. A window is `WINDOW` words in a row; every word of a text begins one, however long the text.  zstandard dictionaries are trained on
   different windows of ordinary and of toxic documents.  A toxic document is mostly ordinary, so the toxic
   dictionary is trained again, `ROUNDS` times, with `REPEATS` more copies of those toxic windows that it shortens by
   more than it does nearly all ordinary ones; ordinary words stay in both dictionaries and cancel out.
3. A window's distance is its compressed length with the ordinary less that with the toxic dictionary.  Thresholds are
   calibrated on labelled documents kept out of the dictionaries: distances that given shares of ordinary windows exceed.
4. A document's features are how many of its windows exceed each threshold, against what is expected of so many
   ordinary ones; a logistic regression on the same labelled documents makes them a score.

Dictionaries, thresholds and weights are some hundred kilobytes whatever the input; scoring moves nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenlens.llm.shared import ready, stored

WINDOW = 3
ROUNDS = 3
REPEATS = 10
#: Least and most bytes of each of the two dictionaries, and bytes of toxic windows that it takes to have one more.
LEAST_BYTES, DICTIONARY_BYTES, BYTES_FOR_ONE = 16_384, 112_640, 150
#: Bytes of the segments that a dictionary is put together from: about a coded word.
SEGMENT = 16
LEVEL = 3
FOLDS = 3
#: Distances are clipped to these when they are counted.
LEAST, MOST = -20, 80
#: Windows a class that dictionaries are trained on, about and at most, drawn by hash from all of its windows.
TRAINING_WINDOWS = 400_000
#: Labelled rows to learn from, about and at most, drawn by hash of the ids.
LABELLED_ROWS = 100_000
#: Documents that thresholds and weights are fitted on, about and at most, drawn by hash.
CALIBRATION_DOCS = 20_000
#: Share of ordinary windows that a window has to surpass to train the toxic dictionary again.
SURPASSED = 0.999
#: Shares of ordinary windows that exceed the thresholds.
EXCEEDING = (0.05, 0.02, 0.005, 0.002, 0.0005)
PRIOR_COUNT = 0.5
RIDGE = 1.0
#: Characters of texts that are coded and compressed at once, and one text more.
CHUNK_CHARACTERS = 2 << 20
#: Words that are coded in step; fewer that are longer than all others are finished one by one.
IN_STEP = 64
_SPACES = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_MARKS = np.isin(np.arange(256), list(b".,;:!?\"'()[]|"))


def _checksums() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC32 = _checksums()


@dataclass
class Coded:
    """Texts as coded words, one after another: how many bytes each word has, and how many words each text."""

    data: bytes
    sizes: np.ndarray
    words: np.ndarray


class Coder:
    """Codes of words: of each byte the low half of the CRC-32 of the word up to there, in two bytes."""

    def words(self, text: str | None) -> list[bytes]:
        """The coded words of a text, A-Z in lower case and without marks at their ends."""
        coded = self.texts([text])
        ends = np.cumsum(coded.sizes)
        return [coded.data[a:b] for a, b in zip((ends - coded.sizes).tolist(), ends.tolist(), strict=True)]

    def texts(self, texts: list[str | None]) -> Coded:
        raw = [(text or "").encode() for text in texts]
        held = np.frombuffer(b" ".join([b"", *raw, b""]).lower(), np.uint8)
        begins, ends = self._bare(held)
        past = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)  # the space after each text
        words = np.diff(np.searchsorted(begins, past), prepend=0)
        return Coded(self._codes(held, begins, ends).tobytes(), (ends - begins) * 2, words)

    def _bare(self, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin and end, marks at their ends left out; a word of marks alone keeps them."""
        spaces, marks = _SPACES[held], _MARKS[held]
        edges = np.flatnonzero(spaces[1:] != spaces[:-1]) + 1
        begins, ends = edges[::2].copy(), edges[1::2].copy()
        plain = np.flatnonzero(~(spaces | marks))
        if not plain.size:
            return begins, ends
        first, last = np.flatnonzero(marks[begins]), np.flatnonzero(marks[ends - 1])
        to = plain[np.minimum(np.searchsorted(plain, begins[first]), plain.size - 1)]
        back = plain[np.maximum(np.searchsorted(plain, ends[last]) - 1, 0)] + 1
        leads, trails = (to >= begins[first]) & (to < ends[first]), (back > begins[last]) & (back <= ends[last])
        begins[first[leads]], ends[last[trails]] = to[leads], back[trails]
        return begins, ends

    def _codes(self, held: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The words' bytes are taken in step, the first of every word, then the second of all that have one, and so on."""
        sizes = ends - begins
        out = np.empty(int(sizes.sum()), "<u2")
        order = np.argsort(-sizes, kind="stable")
        at, to, sizes = begins[order], (np.cumsum(sizes) - sizes)[order], sizes[order]
        state = np.full(len(order), 0xFFFFFFFF, np.uint32)
        longer = np.searchsorted(-sizes, -np.arange(1, (sizes[IN_STEP - 1] if len(sizes) >= IN_STEP else 0) + 1), side="right")
        for i, n in enumerate(longer.tolist()):
            now = state[:n]
            state = _CRC32[(now ^ held[at[:n] + i]) & 0xFF] ^ now >> 8
            out[to[:n] + i] = ~state
        for j in range(min(len(order), IN_STEP - 1)):
            done, size = len(longer), int(sizes[j])
            if size <= done:
                break
            word = held[at[j] : at[j] + size].tobytes()
            code, rest = crc32(word[:done]), []
            for k in range(done, size):
                code = crc32(word[k : k + 1], code)
                rest.append(code & 0xFFFF)
            out[to[j] + done : to[j] + size] = rest
        return out


def chunks(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or "")
        if size >= CHUNK_CHARACTERS:
            yield held
            held, size = [], 0
    if held:
        yield held


def windows(coded: Coded) -> tuple[np.ndarray, np.ndarray]:
    """Where in the coded texts each window begins, and its length; and how many windows each text has.

    Every word begins one that has `WINDOW` words of its text from there on.  A text of fewer words is one window."""
    past = np.cumsum(coded.words)
    ends = np.cumsum(coded.sizes)
    begins = ends - coded.sizes
    number = np.where(coded.words > 0, np.maximum(coded.words - WINDOW + 1, 1), 0)
    text = np.repeat(np.arange(len(number)), number)
    first = np.arange(len(text)) + (past - coded.words - (np.cumsum(number) - number))[text]
    last = np.minimum(first + WINDOW, past[text]) - 1
    return np.stack([begins[first], ends[last] - begins[first]], axis=1).astype(np.uint64), number


class Compressor:
    """Compressed lengths of many windows with one dictionary."""

    def __init__(self, dictionary: bytes):
        known = zstandard.ZstdCompressionDict(dictionary)
        bare = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS
        )
        self.zstd = zstandard.ZstdCompressor(dict_data=known, compression_params=bare)

    def lengths(self, data: bytes, places: np.ndarray) -> np.ndarray:
        if not len(places):
            return np.empty(0, np.int64)
        given = zstandard.BufferWithSegments(data, np.ascontiguousarray(places).tobytes())
        made = self.zstd.multi_compress_to_buffer(given, threads=1)
        lengths = np.fromiter(map(len, made), np.int64, len(made))
        if len(lengths) != len(places):
            raise ValueError("not every window was compressed")
        return lengths


@dataclass
class Model:
    """What a process needs to score texts."""

    ordinary: bytes
    toxic: bytes
    thresholds: np.ndarray
    expected: np.ndarray
    weights: np.ndarray

    def __post_init__(self):
        self.pair = None

    def __getstate__(self):
        return {**self.__dict__, "pair": None}

    def measured(self, texts: Iterable[str | None], coder: Coder) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The distances of all windows of some texts at a time, and how many of them each text has."""
        if self.pair is None:
            self.pair = Compressor(self.ordinary), Compressor(self.toxic)
        for chunk in chunks(texts):
            coded = coder.texts(chunk)
            places, number = windows(coded)
            yield self.pair[0].lengths(coded.data, places) - self.pair[1].lengths(coded.data, places), number

    def distances(self, texts: Iterable[str | None], coder: Coder) -> Iterator[np.ndarray]:
        """The distances of every text's windows."""
        for away, number in self.measured(texts, coder):
            yield from np.split(away, np.cumsum(number)[:-1])

    def counts(self, texts: Iterable[str | None], coder: Coder) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """How many windows of each text exceed each threshold, and how many it has, some texts at a time."""
        for away, number in self.measured(texts, coder):
            text = np.repeat(np.arange(len(number)), number)
            yield np.stack([np.bincount(text[away > t], minlength=len(number)) for t in self.thresholds], axis=1), number

    def features(self, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
        return features(counts, n, self.expected)

    def scores(self, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(self.features(counts, n) @ self.weights)))


def features(counts: np.ndarray, n: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """A constant, and of each threshold the logarithm of the windows over it against those expected."""
    over = np.log((counts + PRIOR_COUNT) / (n[:, None] * expected[None, :] + PRIOR_COUNT))
    return np.concatenate([np.ones((len(n), 1)), over, over[:, -1:] * np.log1p(n)[:, None] / 6], axis=1)


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most so many bytes; of too few samples for a training, they themselves."""
    if sum(map(len, samples)) > 4 * size or len(samples) > 1000:
        try:
            return zstandard.train_dictionary(size, samples, k=SEGMENT, d=8, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass  # too few or too short for it
    return (b"".join(samples)[-size:]).rjust(8, b"\0")


def _placed(samples: list[bytes]) -> tuple[bytes, np.ndarray]:
    size = np.array([len(s) for s in samples], np.uint64)
    return b"".join(samples), np.stack([np.cumsum(size) - size, size], axis=1)


def dictionaries(ordinary: list[bytes], toxic: list[list[bytes]], rounds: int = ROUNDS) -> tuple[bytes, bytes]:
    """The two dictionaries from different windows of each class.

    Half of the ordinary windows train, half are compared with.  The toxic ones come from two sets of documents:
    a window is only repeated where the other set's dictionary shortens it, so not for what its own document put in.
    """
    half = len(ordinary) // 2
    size = min(DICTIONARY_BYTES, max(LEAST_BYTES, sum(len(w) for t in toxic for w in t) // BYTES_FOR_ONE))
    plain = dictionary(ordinary[:half] or ordinary, size)
    if half < 1000 or min(map(len, toxic)) < 1000:
        return plain, dictionary(toxic[0] + toxic[1], size)
    base, rest = Compressor(plain), _placed(ordinary[half:])
    places = [_placed(t) for t in toxic]
    rest_base, bases = base.lengths(*rest), [base.lengths(*p) for p in places]
    now, picked = [dictionary(t, size) for t in toxic], [[], []]
    for _ in range(rounds):
        for i in (0, 1):
            other = Compressor(now[1 - i])
            limit = np.quantile(rest_base - other.lengths(*rest), SURPASSED)
            over = np.flatnonzero(bases[i] - other.lengths(*places[i]) > limit)
            picked[i] = [toxic[i][n] for n in over]
        now = [dictionary(t + p * REPEATS, size) for t, p in zip(toxic, picked, strict=True)]
    return plain, dictionary(toxic[0] + toxic[1] + (picked[0] + picked[1]) * REPEATS, size)


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with a ridge on all but the constant; the rarer label weighs more, by the square root."""
    many = np.array([max(1, (y == k).sum()) for k in (0, 1)])
    each = np.sqrt(len(y) / 2 / many)[y]
    w, ridge = np.zeros(x.shape[1]), np.r_[1e-9, np.full(x.shape[1] - 1, RIDGE)]
    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-x @ w))
        step = np.linalg.solve(
            (x * (each * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (each * (y - p)) - ridge * w
        )
        w = w + step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-9:
            break
    return w


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS) -> DataFrame:
    """text and toxic (0 or 1) of labelled documents; of more than `most` labels a share, by a hash of the ids."""
    known = labels.select(F.col("doc_id").alias("_doc"), F.col("toxic").cast("int").alias("toxic")).where(
        "_doc IS NOT NULL AND toxic IN (0, 1)"
    ).distinct()
    share = min(1.0, most / max(1, known.count()))
    some = known.where(F.pmod(F.xxhash64(F.lit("labelled"), "_doc"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # at most about `most` rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_doc")).select("text", "toxic")


def train(labelled: DataFrame) -> Model:
    """Learns from `labelled` (text, toxic); rows without either teach nothing, and their order does not matter.

    One part in `FOLDS` of the different texts calibrates, the others give windows to the dictionaries.  The driver gets at most
    about TRAINING_WINDOWS windows a class and CALIBRATION_DOCS counts of distances.  Without texts of both
    labels nothing can be told apart: every score is then the share of toxic rows, or 0 without any row.
    """
    spark = ready(labelled.sparkSession)
    fold = F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(FOLDS))
    rows = stored(
        labelled.where("text IS NOT NULL AND toxic IS NOT NULL").select(F.col("text").cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic"))
        .withColumn("fold", fold).withColumn("draw", F.pmod(F.xxhash64(F.lit("draw"), "text"), F.lit(1 << 30))), "labelled",
    )
    words = F.size(F.split("text", "[\\x20\\x09-\\x0D]+"))
    seen = {(r["toxic"], r["fold"] == 0): r for r in rows.groupBy("toxic", "fold").agg(
        F.count("*").alias("n"), F.sum(words.cast("long")).alias("words")
    ).groupBy("toxic", F.when(F.col("fold") == 0, 0).otherwise(1).alias("fold")).agg(
        F.sum("n").alias("n"), F.sum("words").alias("words")
    ).collect()}
    if any((k, c) not in seen for k in (0, 1) for c in (True, False)):
        many = [sum(r["n"] for (k, _), r in seen.items() if k == label) for label in (0, 1)]
        share = many[1] / max(1, sum(many))
        constant = np.log(np.clip(share, 1e-12, 1 - 1e-12) / (1 - np.clip(share, 1e-12, 1 - 1e-12)))
        return Model(b"\0" * 8, b"\0" * 8, np.zeros(0), np.zeros(0), np.array([constant]))
    shares = {k: min(1.0, TRAINING_WINDOWS / max(1, seen[k, False]["words"])) for k in (0, 1)}

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for batch in batches:
            kinds, folds, found = [], [], []
            labels = zip(*(batch.column(c).to_pylist() for c in ("toxic", "fold")), strict=True)
            for chunk in chunks(t.as_py() for t in batch.column("text")):
                coded = coder.texts(chunk)
                places, number = windows(coded)
                for part, (kind, at) in zip(np.split(places, np.cumsum(number)[:-1]), labels, strict=False):
                    some = {coded.data[a : a + n] for a, n in part.tolist()}
                    some = [w for w in some if xxhash.xxh3_64_intdigest(w) < shares[kind] * 2.0**64]
                    found += some
                    kinds += [kind] * len(some)
                    folds += [at % 2 * kind] * len(some)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.int32()), pa.array(folds, pa.int32()), pa.array(found, pa.binary())],
                names=["toxic", "half", "part"],
            )

    drawn = rows.where("fold <> 0").mapInArrow(draw, "toxic int, half int, part binary").distinct().toArrow().to_pydict()
    of: dict[tuple[int, int], list[bytes]] = {(0, 0): [], (1, 0): [], (1, 1): []}
    for kind, at, part in zip(*(drawn[c] for c in ("toxic", "half", "part")), strict=True):
        of[kind, at].append(part)
    for some in of.values():
        some.sort(key=xxhash.xxh3_64_intdigest)
    ordinary, toxic = dictionaries(of[0, 0], [of[1, 0], of[1, 1]])
    model = Model(ordinary, toxic, np.zeros(0), np.zeros(0), np.zeros(0))
    held = spark.sparkContext.broadcast(model)
    share = min(1.0, CALIBRATION_DOCS / sum(seen[k, True]["n"] for k in (0, 1)))
    sample = rows.where(f"fold = 0 AND draw < {int(share * (1 << 30))}")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for batch in batches:
            texts = (t.as_py() for t in batch.column("text"))
            found = [
                np.bincount(np.clip(away, LEAST, MOST) - LEAST, minlength=MOST - LEAST + 1).astype(np.int64)
                for away in held.value.distances(texts, coder)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.int64()))], names=["toxic", "away"])

    met = sample.mapInArrow(measure, "toxic int, away array<long>").toArrow()
    labels = np.array(met.column("toxic").to_pylist(), np.int64)
    away = np.array(met.column("away").to_pylist(), np.int64).reshape(len(labels), MOST - LEAST + 1)
    return calibrated(model, away, labels)


def calibrated(model: Model, away: np.ndarray, labels: np.ndarray) -> Model:
    """The model with thresholds and weights from the counted distances of labelled documents."""
    plain = away[labels == 0].sum(axis=0)
    over = 1.0 - np.cumsum(plain) / max(1, plain.sum())
    at = np.array([int(np.argmax(over <= e)) for e in EXCEEDING])
    thresholds, expected = at + LEAST, np.maximum(over[at], 1e-6)
    counts = np.stack([away[:, i + 1 :].sum(axis=1) for i in at], axis=1)
    weights = logistic(features(counts, away.sum(axis=1), expected), labels)
    return Model(model.ordinary, model.toxic, thresholds, expected, weights)


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5 on) of every row of `docs` (doc_id, text).

    The whole text counts.  A text that is null or has no word has no window: it scores as any ordinary
    text without one.  Rows are scored each by itself, so repeated rows score alike; ids, which may be of any type, null or
    repeated, are handed through; other columns are not read; an empty table gives no rows.
    """
    spark = ready(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)  # two dictionaries of at most DICTIONARY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, model = Coder(), held.value
        for batch in batches:
            if model.thresholds.size:
                met = model.counts((t.as_py() for t in batch.column("text")), coder)
                scores = np.concatenate([np.empty(0), *(model.scores(counts, n) for counts, n in met)])
            else:
                scores = np.full(batch.num_rows, 1.0 / (1.0 + np.exp(-model.weights[0])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(scores >= 0.5, pa.bool_()).cast(pa.int32())],
                names=["doc_id", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, score double, predicted int"
    )
