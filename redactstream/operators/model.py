"""The model tier: batched inference over free text and what its spans become.

The neural model itself is the user's. The contract is a loader that runs once per
Python worker and returns `predict(texts, labels, threshold)`; the engine batches
through Arrow, chunks, isolates failures per record and does all span work in the JVM.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactstream.functions import spans
from redactstream.functions.address import CITIES, extend_address
from redactstream.functions.spans import bridge_spans, find_spans, finding
from redactstream.operators.skew import fits_broadcast, salted_join
from redactstream.schema import FINDINGS, MODEL_SPAN, MODEL_THRESHOLD, TIER_MODEL, TIER_RULES

# What each entity type is called towards a zero-shot model.
LABEL_GROUPS = {
    "PERSON_NAME": ("person", "first_name", "last_name"),
    "ADDRESS": ("address", "street_address", "location"),
}
CHUNK = 8
WINDOW_OVERLAP = 200
MAX_BRIDGE = 32

Prediction = Sequence[tuple[int, int, float]]
Predict = Callable[[list[str], Sequence[str], float], Sequence[Prediction]]


@dataclass(frozen=True)
class BatchPredictor:
    """A Python model. `load()` runs once per worker and returns the predict function."""

    load: Callable[[], Predict]
    label_groups: dict[str, Sequence[str]] = field(default_factory=lambda: dict(LABEL_GROUPS))
    threshold: float = MODEL_THRESHOLD
    extend: bool = True
    chunk: int = CHUNK
    # What the model reads at once; longer texts go in windows that overlap. None: no limit.
    max_chars: int | None = None
    overlap: int = WINDOW_OVERLAP


def windowed(predict: Predict, chars: int, overlap: int) -> Predict:
    """The same predictions on texts of any length: windows overlap by `overlap` characters.

    Spans are shifted back. One that lies inside another of its text, as where a window
    cuts it, or that repeats it, gives way.
    """

    def run(texts, labels, threshold):
        step = chars - overlap
        parts = [
            (i, at) for i, t in enumerate(texts) for at in range(0, max(len(t) - overlap, 1), step)
        ]
        found = predict([texts[i][at : at + chars] for i, at in parts], labels, threshold)
        if len(found) != len(parts):
            raise ValueError("the model returned another number of results than texts")
        out: list[list] = [[] for _ in texts]
        for (i, at), spans_ in zip(parts, found):
            out[i] += [(s + at, e + at, p) for s, e, p in spans_]
        return [outermost(x) for x in out]

    return run


def outermost(found: list) -> list:
    """Spans by start, less those inside another; equal spans keep the best score."""
    kept: list = []
    for s, e, p in sorted(found, key=lambda x: (x[0], -x[1], -x[2])):
        if not kept or e > kept[-1][1]:
            kept.append((s, e, p))
    return kept


def checked_span(s, e, text: str) -> tuple[int, int]:
    """The span, if it lies in the text; otherwise the record must fail."""
    s, e = int(s), int(e)
    if not 0 <= s < e <= len(text):
        raise ValueError("a span lies outside its text")
    return s, e


@dataclass(frozen=True)
class DictionaryPredictor:
    """An offline stand-in, not a model: known words on token boundaries, one fixed score.

    It is a Column expression, so it adds no Python stage. The word lists are parameters
    and must stay small; `dictionary_spans` joins against a dictionary of any size.
    """

    first_names: Sequence[str] = ("Nadia", "Tariq", "Samina", "Noor", "Rabia", "Shahid")
    last_names: Sequence[str] = ("Lodhi", "Mirza", "Gilani", "Raza", "Warraich")
    places: Sequence[str] = (*CITIES, "PECHS", "Gulberg", "Clifton")
    score: float = 0.9
    threshold: float = MODEL_THRESHOLD
    extend: bool = True

    def _hits(self, text: Column, entity: str, pattern: str) -> Column:
        return F.transform(
            find_spans(text, spans.WORD_START + pattern + spans.WORD_END),
            lambda h: F.struct(
                F.lit(entity).alias("entity_type"),
                h["s"].alias("s"),
                h["e"].alias("e"),
                F.lit(self.score).alias("score"),
            ),
        )

    def spans(self, text: Column) -> Column:
        if self.score < self.threshold:
            return spans.empty(f"array<{MODEL_SPAN}>")
        first, last = "|".join(self.first_names), "|".join(self.last_names)
        person = self._hits(text, "PERSON_NAME", f"(?:{first})(?: (?:{last}))?")
        place = self._hits(text, "ADDRESS", f"(?:{'|'.join(self.places)})")
        return spans.joined(person, place)


Predictor = BatchPredictor | DictionaryPredictor

_RESULT = f"spans: array<array<{MODEL_SPAN}>>, error: string, ms: double"


def _infer(predictor: BatchPredictor, predict: Predict, texts: list[str]) -> list[list[dict]]:
    """One pass per label group over chunks of texts; results line up with the texts."""
    out: list[list[dict]] = [[] for _ in texts]
    if predictor.max_chars:
        predict = windowed(predict, predictor.max_chars, predictor.overlap)
    for at in range(0, len(texts), predictor.chunk):
        part = texts[at : at + predictor.chunk]
        for entity, labels in predictor.label_groups.items():
            results = list(predict(part, list(labels), predictor.threshold))
            if len(results) != len(part):
                raise ValueError("the model returned another number of results than texts")
            for i, found in enumerate(results):
                for s, e, p in found:
                    s, e = checked_span(s, e, part[i])
                    out[at + i].append({"entity_type": entity, "s": s, "e": e, "score": float(p)})
    return out


def model_udf(predictor: BatchPredictor):
    """Arrow UDF: array<string> of texts per row to spans per text, an error and a time."""

    @F.pandas_udf(_RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = None
        for rows in batches:
            lists = [[] if r is None else list(r) for r in rows]
            flat = [t for r in lists for t in r]
            errors: list[str | None] = [None] * len(lists)
            started = time.perf_counter()
            grouped: list[list[list[dict]]]
            if flat and predict is None:
                predict = predictor.load()
            try:
                found = iter(_infer(predictor, predict, flat) if flat else [])
                grouped = [[next(found) for _ in r] for r in lists]
            except Exception:
                grouped = []
                for i, r in enumerate(lists):
                    try:
                        grouped.append(_infer(predictor, predict, r))
                    except Exception as exc:
                        errors[i] = type(exc).__name__
                        grouped.append([])
            used = sum(1 for r in lists if r)
            share = (time.perf_counter() - started) * 1000.0 / used if used else 0.0
            yield pd.DataFrame(
                {
                    "spans": grouped,
                    "error": errors,
                    "ms": [share if r else 0.0 for r in lists],
                }
            )

    return run


def model_to_findings(text: Column, field_name: Column, found: Column, extend: bool = True) -> Column:
    """Model spans of one text as findings; addresses are widened, then bridged as a set."""

    def as_finding(entity: Column, x: Column) -> Column:
        return finding(entity, field_name, x["s"], x["e"], TIER_MODEL, x["score"])

    if not extend:
        return F.transform(found, lambda x: as_finding(x["entity_type"], x))
    return spans.let(found, lambda f: _extended(text, f, as_finding))


def _extended(text: Column, found: Column, as_finding: Callable[[Column, Column], Column]) -> Column:
    others = F.transform(
        F.filter(found, lambda x: x["entity_type"] != "ADDRESS"),
        lambda x: as_finding(x["entity_type"], x),
    )

    def widened(x: Column) -> Column:
        return spans.let(
            extend_address(text, x["s"], x["e"]),
            lambda w: F.struct(w["s"].alias("s"), w["e"].alias("e"), x["score"].alias("score")),
        )

    def bridged(addresses: Column) -> Column:
        return F.transform(bridge_spans(addresses, MAX_BRIDGE), lambda x: as_finding(F.lit("ADDRESS"), x))

    addresses = F.transform(F.filter(found, lambda x: x["entity_type"] == "ADDRESS"), widened)
    # Widening walks the text, so it is bound once; texts without an address skip it.
    has_address = F.exists(found, lambda x: x["entity_type"] == "ADDRESS")
    return F.when(has_address, spans.joined(others, spans.let(addresses, bridged))).otherwise(others)


def _parts(free: str) -> Column:
    return F.coalesce(F.col(free), spans.empty("array<struct<field:string,text:string>>"))


@spans.built_once
def _dictionary_findings(free: str, predictor: DictionaryPredictor) -> Column:
    found = F.transform(
        _parts(free),
        lambda p: model_to_findings(
            p["text"], p["field"], predictor.spans(p["text"]), predictor.extend
        ),
    )
    return spans.once(F.flatten(found))


@spans.built_once
def _batch_findings(free: str, extend: bool) -> Column:
    found = F.zip_with(
        _parts(free),
        F.col("_model.spans"),
        lambda p, x: model_to_findings(
            p["text"], p["field"], F.coalesce(x, spans.empty(f"array<{MODEL_SPAN}>")), extend
        ),
    )
    return spans.once(F.coalesce(F.flatten(found), spans.empty(FINDINGS)))


def detect_model(df: DataFrame, free: str, predictor: Predictor) -> DataFrame:
    """Adds model_findings, model_error and model_ms from `free`: array<struct<field,text>>.

    The row keeps all its columns, so results need no join back to their text. Rows
    without free text pass through the Arrow stage without a call to the model.
    """
    if isinstance(predictor, DictionaryPredictor):
        return df.withColumns(
            {
                "model_findings": _dictionary_findings(free, predictor),
                "model_error": F.lit(None).cast("string"),
                "model_ms": F.lit(0.0),
            }
        )
    texts = F.transform(_parts(free), lambda p: p["text"])
    out = df.withColumn("_model", model_udf(predictor)(texts))
    return out.withColumns(
        {
            "model_findings": _batch_findings(free, predictor.extend),
            "model_error": F.col("_model.error"),
            "model_ms": F.col("_model.ms"),
        }
    ).drop("_model")


def model_spans(
    df: DataFrame, text: str, predictor: Predictor, field_name: str = "memo"
) -> DataFrame:
    """Adds `spans`, the model findings of one text column; blank texts cost nothing."""
    blank = ~F.col(text).rlike(rf"[^{spans.SPACE}]")
    part = F.struct(F.lit(field_name).alias("field"), F.col(text).alias("text"))
    free = F.when(F.col(text).isNull() | blank, F.lit(None)).otherwise(F.array(part))
    out = detect_model(df.withColumn("_free", free), "_free", predictor)
    return out.withColumnRenamed("model_findings", "spans").drop("_free")


# --------------------------------------------------------------------------- #
# Detectors that only exist in Python
# --------------------------------------------------------------------------- #
Found = Sequence[tuple[str, int, int, float]]


@dataclass(frozen=True)
class PythonDetector:
    """A rule detector written in Python. `load()` runs once per worker and returns
    `detect(text, field)`, which lists (entity type, start, end, confidence)."""

    load: Callable[[], Callable[[str, str], Found]]


def all_of(*detectors: PythonDetector) -> PythonDetector:
    """Several detectors as one, in a single pass over the rows; one that raises fails the record."""

    def load():
        loaded = [d.load() for d in detectors]
        return lambda text, field: [found for detect in loaded for found in detect(text, field)]

    return PythonDetector(load)


def detector_udf(detector: PythonDetector):
    @F.pandas_udf(f"found: {FINDINGS}, error: string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        detect = detector.load()
        for fields, texts in batches:
            found, errors = [], []
            for names, values in zip(fields, texts):
                row: list[dict] = []
                error = None
                try:
                    for name, text in zip(names, values):
                        for kind, s, e, p in detect(text, name):
                            s, e = checked_span(s, e, text)
                            row.append(
                                {
                                    "entity_type": kind,
                                    "field": name,
                                    "span_start": s,
                                    "span_end": e,
                                    "tier": TIER_RULES,
                                    "confidence": float(p),
                                }
                            )
                except Exception as exc:
                    row, error = [], type(exc).__name__
                found.append(row)
                errors.append(error)
            yield pd.DataFrame({"found": found, "error": errors})

    return run


def detect_python(df: DataFrame, parts: str, detector: PythonDetector) -> DataFrame:
    """Adds custom_findings and detector_error from `parts`: array<struct<field,text>>.

    A detector that raises on a record fails that record only; the caller holds it.
    """
    col = F.coalesce(F.col(parts), spans.empty("array<struct<field:string,text:string>>"))
    names = F.transform(col, lambda p: p["field"])
    texts = F.transform(col, lambda p: p["text"])
    out = df.withColumn("_custom", detector_udf(detector)(names, texts))
    return out.withColumns(
        {"custom_findings": F.col("_custom.found"), "detector_error": F.col("_custom.error")}
    ).drop("_custom")


def latency_share(decided: DataFrame) -> DataFrame:
    """Model time over the records that used it, whether or not anything was found."""
    used = F.size(F.coalesce(F.col("_free"), F.array())) > 0
    return decided.agg(
        F.count_if(used).alias("records"),
        F.coalesce(F.sum("model_ms"), F.lit(0.0)).alias("model_ms"),
        F.try_divide(F.sum("model_ms"), F.count_if(used)).alias("ms_per_record"),
    )


def dictionary_spans(df: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """Relational dictionary lookup: one row per token that is in `names`.

    `names` has columns word, entity_type, score and may be of any size. Its size is measured: a
    dictionary within the broadcast bounds goes to the tokens, which stay where they are; a larger one
    meets them in a join on the word, in which frequent tokens are salted.
    """
    words = df.select(key, spans.once(find_spans(F.col(text), r"\p{L}+")).alias("t"))
    tokens = words.select(key, F.explode("t").alias("t")).select(key, F.col("t.m").alias("word"), F.col("t.s").alias("s"), F.col("t.e").alias("e"))
    if fits_broadcast(names):
        found = tokens.join(F.broadcast(names), "word")
    else:
        found = salted_join(tokens, names, "word", F.struct(key, "s"))
    return found.select(key, "entity_type", "s", "e", "score", "word")
