"""Missing or wrong language labels: a language with confidence for each document and each segment of a mixed one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinegrain.llm.language_model import CHUNK, ByteGru, paragraphs, to_bytes, to_chunks

# Names and longer codes of languages; two-letter codes stand for themselves.
LANGUAGE_NAMES = {
    "eng": "en", "english": "en", "hin": "hi", "hindi": "hi", "हिन्दी": "hi", "हिंदी": "hi", "mar": "mr", "marathi": "mr", "मराठी": "mr",
    "ben": "bn", "bengali": "bn", "bangla": "bn", "বাংলা": "bn", "tam": "ta", "tamil": "ta", "தமிழ்": "ta", "spa": "es", "spanish": "es", "español": "es",
    "espanol": "es", "castellano": "es", "por": "pt", "portuguese": "pt", "português": "pt", "portugues": "pt", "fra": "fr", "fre": "fr", "french": "fr",
    "français": "fr", "francais": "fr", "deu": "de", "ger": "de", "german": "de", "deutsch": "de", "ita": "it", "italian": "it", "rus": "ru", "russian": "ru",
    "tel": "te", "telugu": "te", "mal": "ml", "malayalam": "ml", "kan": "kn", "kannada": "kn", "guj": "gu", "gujarati": "gu", "pan": "pa", "punjabi": "pa", "urd": "ur", "urdu": "ur",
}
PRIOR_LETTERS = 8.0


def label_code(label: Column) -> Column:
    """The two-letter code a label means; null for a missing or undetermined one."""
    head = F.split(F.lower(F.trim(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))), r"[-_;,/ ]")[0]
    names = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, head), F.when(head.rlike("^[a-z]{2}$") & (head != "xx"), head))


def training_chunks(docs: DataFrame, key: str, text: str, label: str, per_language: int, per_document: int, least_documents: int = 3) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, chunks, label numbers) of about ``per_language`` labelled documents of each language.

    Every code with at least ``least_documents`` labelled texts is a language; a code has two letters, so there are 676
    at most. Documents are taken by a hash of their key, at most ``per_document`` chunks from anywhere in a text; what
    comes to the driver is bounded by languages times per_language times per_document chunks of CHUNK letters, twice at
    most.
    """
    coded = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), label_code(F.col(label)).alias("code")).filter(f"code is not null and length(trim(text)) >= {CHUNK // 2}")
    counts = {r["code"]: r["count"] for r in coded.groupBy("code").count().filter(F.col("count") >= least_documents).collect()}
    if not counts:
        return [], np.zeros((0, CHUNK), np.uint32), np.zeros(0, np.int64)
    shares = F.create_map(*[F.lit(x) for c, n in sorted(counts.items()) for x in (c, min(1.0, per_language / n))])
    taken = coded.filter(F.pmod(F.xxhash64("key"), F.lit(1_000_003)) < F.try_element_at(shares, F.col("code")) * 1_000_003)

    def run(batches):
        for batch in batches:
            rows = []
            for k, t, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                chunks = to_chunks(to_bytes(t))
                chunks = chunks[(chunks != 0).sum(axis=1) >= CHUNK // 4]
                rng = np.random.default_rng(0 if k is None else int(k) % 2**31)
                rows += [(c, int(k or 0), x.tobytes()) for x in chunks[rng.permutation(len(chunks))[:per_document]]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["code", "key", "chunk"])

    most = 2 * len(counts) * per_language * per_document
    rows = sorted(taken.select(F.col("key").cast("long"), "text", "code").mapInArrow(run, "code string, key long, chunk binary").limit(most).collect())
    languages = sorted(counts)
    number = {c: i for i, c in enumerate(languages)}
    chunks = np.frombuffer(b"".join(bytes(r["chunk"]) for r in rows), np.uint32).reshape(-1, CHUNK)
    return languages, chunks, np.array([number[r["code"]] for r in rows], np.int64)


def fitted(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = 600, per_document: int = 5, hidden: int = 12, steps: int = 540) -> ByteGru | None:
    """A network trained on a bounded sample; None without labels.

    Labels may be wrong: after two thirds of the steps, chunks whose label the network finds unlikely are set aside,
    and it goes on with the rest.
    """
    languages, chunks, labels = training_chunks(docs, key, text, label, per_language, per_document)
    if not len(chunks):
        return None
    net = ByteGru(languages, hidden)
    net.train(chunks, labels, steps=steps * 2 // 3)
    sums, letters = net.pooled(chunks)
    likely = sums[np.arange(len(labels)), labels] / np.maximum(letters, 1) >= 0.3
    if likely.any():
        net.train(chunks[likely], labels[likely], steps=steps - steps * 2 // 3, rate=0.008, seed=13)
    return net


def label_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", **fit) -> DataFrame:
    """(key, seg INT, lang, confidence, label): the language of each document and segment.

    seg 0 is the document with its main language, that of most letters; seg 1, 2, ... are its runs of paragraphs in
    one language, where there is more than one. ``label`` is the code of the given label. The network labels every
    letter; a paragraph pools the probabilities of its letters, with those of the whole document as a prior of a few
    letters. Equal paragraphs of a batch are read once. One narrow pass; the weights (under 1 MB) go to every task.

    Defined cases: a null, empty or wordless text has no rows; paragraphs without letters belong to none; without any
    usable label there are no rows; repeated rows come out as often.
    """
    net = fitted(docs, key, text, label, **fit)
    schema = "key long, seg int, lang string, confidence double, label string"
    if net is None:
        return docs.sparkSession.createDataFrame([], schema).toDF(key, "seg", "lang", "confidence", "label")
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        model = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                yield from _labelled(model, whole.slice(at, 2000))

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), label_code(F.col(label)).alias("label")).filter("text is not null and text <> ''")
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def _labelled(model: ByteGru, batch: pa.RecordBatch):
    parts: dict[str, int] = {}
    rows, pieces = [], []
    for k, t, given in zip(*(batch.column(i).to_pylist() for i in range(3))):
        own = []
        for p in paragraphs(t):
            if p not in parts:
                parts[p] = len(pieces)
                pieces.append(to_bytes(p))
            own.append(parts[p])
        rows.append((k, given, own))
    chunked = [to_chunks(c) for c in pieces]
    ends = np.cumsum([0, *map(len, chunked)])
    if not len(chunked):
        return
    # Chunks of all paragraphs go through the network together.
    sums, letters = model.pooled(np.vstack(chunked))
    starts = ends[:-1]
    sums, letters = np.add.reduceat(sums, starts, axis=0), np.add.reduceat(letters, starts)
    out = {n: [] for n in ("key", "seg", "lang", "confidence", "label")}

    def emit(k, seg, lang, confidence, given):
        for n, v in zip(out, (k, seg, model.languages[lang], confidence, given)):
            out[n].append(v)

    for k, given, own in rows:
        own = [i for i in own if letters[i] > 0]
        if not own:
            continue
        total = sums[own].sum(axis=0)
        prior = total / total.sum() * PRIOR_LETTERS
        pooled = sums[own] + prior
        best = pooled.argmax(axis=1)
        main = int(np.bincount(best, letters[own], len(model.languages)).argmax())
        emit(k, 0, main, float(total[main] / total.sum()), given)
        if (best != best[0]).any():
            seg, i = 0, 0
            while i < len(own):
                j = i
                while j < len(own) and best[j] == best[i]:
                    j += 1
                run = sums[own[i:j]].sum(axis=0)
                seg += 1
                emit(k, seg, int(best[i]), float(run[best[i]] / run.sum()), given)
                i = j
    yield pa.RecordBatch.from_arrays([pa.array(out["key"], pa.int64()), pa.array(out["seg"], pa.int32()), pa.array(out["lang"], pa.string()), pa.array(out["confidence"], pa.float64()), pa.array(out["label"], pa.string())], names=list(out))
