"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (one to three letters) that both have, each counted
once however often it occurs, divided by the geometric mean of the numbers each has: a blended-spectrum presence
kernel. Landmark texts give Nystroem features, on which ridge regression is fitted one language against the rest.
As a kernel with a landmark is an inner product of presence vectors, a batch of texts is scored by two matrix
products: presence by landmarks, and that by the fitted weights.

Whether a text is in a learned language at all is told by the margin between its two best languages, which is near 1 for
a text of a learned language and near 0 for others however many languages there are. The level that parts the two is
calibrated on rows held out, with each language left out of a fit in turn.

The fit is on the driver over a sample of bounded size (parameters ``per_language``, ``landmarks``, ``sample_chars``);
scoring covers every whole text, where the data lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusaudit.llm.common import strings

#: Classes of characters: 0 what is no letter, 1 letters the sample does not have often, others one letter each.
CLASSES = 128
UNDETERMINED = "und"
_BATCH = 64
#: Texts with fewer distinct n-grams have too little evidence for a margin and go by their letters alone.
SHORT = 64
#: Margin asked where fewer than three languages leave nothing to calibrate on.
LEVEL = 0.5
#: Languages are left out one by one, or in so many groups if there are more.
LEFT_OUT = 8


def letters_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Model:
    languages: list[str]
    classes: np.ndarray  # class of each code point
    column: np.ndarray  # column of each n-gram of classes; the last column is of n-grams no landmark has
    landmarks: np.ndarray  # presence of n-grams x landmarks, each landmark divided by the root of its number
    weights: np.ndarray  # (landmarks + 1) x languages
    level: float = LEVEL  # margin of a text in a learned language

    def columns(self, text: str) -> np.ndarray:
        """Columns of the n-grams of a text, repeats included."""
        return self.column[self.grams(text)]

    def grams(self, text: str) -> np.ndarray:
        """Numbers of the n-grams of a text, repeats included; runs of other characters count as one gap."""
        c = self.classes[letters_of(text)]
        c = np.concatenate([[0], c, [0]]).astype(np.int32)
        c = c[(c > 0) | np.concatenate([[True], c[:-1] > 0])]
        two = c[:-1] * CLASSES + c[1:]
        three = two[:-1] * CLASSES + c[2:]
        # one letter: 0..C-1, two: from C, three: from C + C^2
        return np.concatenate([c, two + CLASSES, three + CLASSES + CLASSES**2])

    def features(self, texts: list[str]) -> np.ndarray:
        """Normalised kernels with the landmarks, and a constant."""
        seen = np.zeros((len(texts), self.landmarks.shape[0] + 1), np.float32)
        for row, text in zip(seen, texts):
            row[self.columns(text)] = 1
        seen = seen[:, :-1]
        kernels = seen @ self.landmarks / np.sqrt(np.maximum(seen.sum(axis=1, keepdims=True), 1))
        return np.hstack([kernels, np.ones((len(texts), 1), np.float32)])

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and the regression's estimate of its probability; ``und`` and 0 where there is no letter."""
        langs, scores = [], []
        for a in range(0, len(texts), _BATCH):
            part = texts[a : a + _BATCH]
            letters = [bool((self.classes[letters_of(t)] > 0).any()) for t in part]
            if not self.languages:
                langs += [UNDETERMINED] * len(part)
                scores += [0.0] * len(part)
                continue
            values = self.features(part) @ self.weights
            best = values.argmax(axis=1)
            for ok, b, v in zip(letters, best, values.max(axis=1)):
                langs.append(self.languages[b] if ok else UNDETERMINED)
                scores.append(float(min(1.0, max(0.0, (v + 1) / 2))) if ok else 0.0)
        return langs, scores


    def margins(self, texts: list[str]) -> np.ndarray:
        """Half the distance between the two best languages of each text; of a single language 1."""
        if len(self.languages) < 2:
            return np.full(len(texts), float(len(self.languages)))
        parts = [self.features(texts[a : a + _BATCH]) @ self.weights for a in range(0, len(texts), _BATCH)]
        best = np.sort(np.concatenate(parts or [np.empty((0, 2))]), axis=1)
        return (best[:, -1] - best[:, -2]) / 2

    def known(self, texts: list[str]) -> list[bool]:
        """Whether each text is in a learned language: at least half of its letters are of the sample, and the margin
        reaches the level or the text is too short for one."""
        out = []
        for text, margin in zip(texts, self.margins(texts)):
            c = self.classes[letters_of(text)]
            letters, own = int((c > 0).sum()), int((c > 1).sum())
            out.append(bool(self.languages) and 0 < letters <= 2 * own and (margin >= self.level or self.is_short(text)))
        return out

    def is_short(self, text: str) -> bool:
        return 3 * len(text) < SHORT or len(text) < SHORT and len(np.unique(self.grams(text))) < SHORT


def calibrated_level(rows: list[tuple[str, str]], landmarks: int) -> float:
    """The margin with the fewest errors, as parts of each kind, between held-out rows of learned languages and of languages
    left out; in the middle of the margins that do equally well.

    Models are fitted on every other row of each language, without one language (or group of ``LEFT_OUT``) in turn, and
    asked about the rest.
    """
    languages = sorted({lang for lang, _ in rows})
    if len(languages) < 3:
        return LEVEL
    by = {lang: [t for x, t in rows if x == lang] for lang in languages}
    taught = [(lang, t) for lang in languages for t in by[lang][::2]]
    asked = [(lang, t) for lang in languages for t in by[lang][1::2]]
    inside, outside = [], []
    groups = min(LEFT_OUT, len(languages))
    for g in range(groups):
        out = set(languages[g::groups])
        if len(languages) - len(out) < 2:
            continue
        model = fit([r for r in taught if r[0] not in out], landmarks)
        long = [(lang, t) for lang, t in asked if not model.is_short(t)]
        for (lang, _), margin in zip(long, model.margins([t for _, t in long])):
            (outside if lang in out else inside).append(margin)
    if not inside or not outside:
        return LEVEL
    inside, outside = np.sort(inside), np.sort(outside)
    at = np.unique(np.concatenate([inside, outside]))
    middle = (at[1:] + at[:-1]) / 2
    if not len(middle):
        return LEVEL
    wrong = np.searchsorted(inside, middle) / len(inside) + 1 - np.searchsorted(outside, middle) / len(outside)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    return float((at[best[0]] + at[best[-1] + 1]) / 2) if len(best) == best[-1] - best[0] + 1 else float(middle[best[0]])


def fit(rows: list[tuple[str, str]], landmarks: int = 240, ridge: float = 1e-3) -> Model:
    """A model from (language, text) rows; landmarks are taken in turn from the languages."""
    languages = sorted({lang for lang, _ in rows})
    counts: dict[int, int] = {}
    for _, text in rows:
        for c, n in zip(*np.unique(letters_of(text.lower()), return_counts=True)):
            if chr(c).isalpha():
                counts[int(c)] = counts.get(int(c), 0) + int(n)
    own = sorted(counts, key=lambda c: (-counts[c], c))[: CLASSES - 2]
    classes = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.uint8, 0x110000)
    for i, c in enumerate(own):
        for form in {chr(c), chr(c).upper(), chr(c).title()}:
            if len(form) == 1:
                classes[ord(form)] = i + 2
    model = Model(languages, classes, np.arange(CLASSES + CLASSES**2 + CLASSES**3, dtype=np.int32), np.empty((0, 0)), np.empty((0, 0)))
    if not languages:
        return model
    by = {lang: [t for x, t in rows if x == lang] for lang in languages}
    turns = [by[lang][i] for i in range(max(map(len, by.values()))) for lang in languages if i < len(by[lang])][:landmarks]
    grams = [np.unique(model.columns(t)) for t in turns]
    known = np.unique(np.concatenate(grams))
    column = np.full(len(model.column), len(known), np.int16 if len(known) < 1 << 15 else np.int32)
    column[known] = np.arange(len(known))
    model.column = column
    marks = np.zeros((len(known), len(turns)), np.float32)
    for j, g in enumerate(grams):
        marks[column[g], j] = 1 / np.sqrt(len(g))
    model.landmarks = marks
    # Nystroem: features are kernels times the inverse root of the kernel matrix of the landmarks
    value, vector = np.linalg.eigh(marks.T @ marks)
    keep = value > value.max() * 1e-6
    root = vector[:, keep] / np.sqrt(value[keep])
    blocks = [model.features([t for _, t in rows[a : a + _BATCH]]) for a in range(0, len(rows), _BATCH)]
    x = np.vstack(blocks).astype(np.float64)
    z = np.hstack([x[:, :-1] @ root, x[:, -1:]])
    y = np.where(np.array([[lang == k for k in languages] for lang, _ in rows]), 1.0, -1.0)
    # languages weigh alike however many rows they have
    share = np.array([len(rows) / len(by[lang]) for lang, _ in rows])[:, None]
    w = np.linalg.solve(z.T @ (share * z) + ridge * share.sum() * np.eye(z.shape[1]), z.T @ (share * y))
    model.weights = np.vstack([root @ w[:-1], w[-1:]]).astype(np.float32)
    return model


def sample_labelled(docs: DataFrame, per_language: int, sample_chars: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """At most ``per_language`` labelled texts of each language, of at most ``sample_chars``, by a hash of the id.

    A hash threshold for each language thins the rows where they lie, before any are moved or ordered, so no
    language gathers in one task. The thresholds have a row for each language, as the model has.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & (F.length(text_col) <= sample_chars))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(1 << 40)).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    below = [F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, int((1 << 40) * min(1.0, 3 * per_language / n)))]
    thin = rows.where(F.col("h") <= F.element_at(F.create_map(*below), F.col("lang"))) if counts else rows.limit(0)
    order = Window.partitionBy("lang").orderBy("h", "text")
    return thin.select("lang", "text", F.row_number().over(order).alias("k")).where(F.col("k") <= per_language)


def fit_language_model(
    labelled: DataFrame,
    per_language: int = 300,
    landmarks: int = 240,
    sample_chars: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    calibrate: bool = False,
) -> Model:
    """Fit on a sample of ``labelled`` bounded by the parameters; without labelled text the model knows no language.

    ``calibrate`` also finds the level that ``keep_known_languages`` asks for, by further fits on half the sample.
    """
    rows = sample_labelled(labelled, per_language, sample_chars, id_col, text_col, lang_col).collect()
    rows = [(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["k"], r["lang"]))]
    model = fit(rows, landmarks)
    if calibrate:
        model.level = calibrated_level(rows, landmarks)
    return model


def predict_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``lang_pred``, ``score`` (0 to 1), from the whole text alone.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if the model knows no language.
    Ids pass through (null stays null), repeated rows give repeated rows, an empty table an empty result. The model
    is sent to the executors once; its size is bounded by its parameters (classes and landmarks), not by the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.predict(strings(batch, text_col))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def keep_known_languages(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents, all columns, that are in a language the model knows (``Model.known``).

    Row-local: nothing is shuffled. Texts that are null or have no letter go, and so do texts whose letters are mostly
    not those of the sample or whose margin is below the model's level; a text too short for a margin stays if its
    letters are known. Of a model of one language only the letters count. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.known(strings(batch, text_col)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
