"""Subject areas of texts by a distributed latent Dirichlet topic model.

1. `encode_sentences` cuts every text into sentences and words. A word is folded (case, accents, the usual misreadings of l, o and m, marks of no width) and hashed into BUCKETS buckets.
2. `fit_topics` fits TOPICS topics to the texts without any list of words: variational EM from random topics, each step of which takes the expectations of all texts in parallel, until the bound of all texts stops
   rising; Spark adds their sums, and the driver keeps only the topic-term matrix, VOCABULARY terms wide whatever the corpus. A topic's prior share follows its size, so common wording gathers in a few topics.
3. `topic_subjects` names the topics: a topic belongs to the subject whose inspected top terms (INSPECTED) have most of its probability, or to the running of the count, which is no subject, or, where it has
   hardly any of them, to common wording. `topic_terms` shows the top terms of a fit with that name.
4. `assign_subjects` gives each running sentence the subject with most of it under the topic proportions of its text; one of common wording only carries on and has that of the sentence before. A text has the
   subjects that make up at least SHARE of its running sentences. Headings and tables of figures end in no full stop before their line or paragraph does, and are no running sentences.
   A remark in passing is of no subject where topics of such remarks hold more of it than its subject's topics; else it is one sentence of that subject.

Nulls and edge cases: null, empty and white-space texts, and texts without a running sentence, have no subject (no row); texts of any length are read whole; each row is judged by itself, so repeated rows repeat
their subjects; ties between subjects of a sentence go to the first subject by name; an empty table gives an empty result; extra columns are ignored; null or repeated subjects in the table of areas count once or not at all.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulara.session import cut, ship_code

BUCKETS = 1 << 20
#: Terms of the model: the most frequent ones, but for words that make up more than COMMON of all words (function words, which tell no subject) and those used less than LEAST_COUNT times.
VOCABULARY = 8192
COMMON = 0.006
LEAST_COUNT = 4
TOPICS = 64
#: EM ends when the bound per word of all texts rises by less than RISE in a step.
RISE = 0.0008
SHARE = 0.25
#: Prior of a topic's share in a text (times the topics' number and the topic's weight), and of a term in a topic; steps of a text's expectation.
ALPHA, ETA, INNER = 0.1, 0.01, 3
#: Texts of like length take their expectation together, in groups of so many cells (texts times terms). Tasks' sums are added up in whole parts of a use, so that their order makes no difference, in pieces of so many numbers.
CELLS, PARTS, PIECE = 8192, 4096, 8192
#: Words of the texts that are judged at once.
WORDS = 1 << 17

#: Top terms that name a topic, found by inspecting topics of fits to sf0.01 and sf0.1; "" stands for the running of the count and remarks in passing, which are no subject. They take no part in the fit. A subject
#: that isn't here is named by the words of its titles.
INSPECTED = {
    "anggaran": "anggaran belanja rupiah honor bendahara kas kuitansi pajak dana realisasi budget cash auditor treasurer tax balance paymaster outturn vouchers grant",
    "hukum": "hukum pemohon gugatan putusan sidang saksi majelis panitera pasal kuasa hearing petitioner counsel witness registrar respondent ruling petition statute appeal",
    "kesehatan": "medis perawat bidan puskesmas pasien demam obat kelelahan dokter ambulans doctor nurse midwife health fever clinic fatigue heart medical dehydration",
    "logistik": "gudang kotak segel palet kurir truk perahu bilik sopir armada warehouse ballot boxes courier truck delivery pallet boat seals loading",
    "olahraga": "lomba gawang pelatih kapten wasit final voli tangkis piala skor captain coach goalkeeper cup trophy volleyball badminton relay football score",
    "pemetaan": "batas peta satelit poligon atlas kartografer koordinat bujur citra ukur boundary map grid coordinate satellite polygon cartographer surveyor tile layer",
    "statistik": "sampel median statistik survei sensus hipotesis regresi acak rerata pencilan statistician survey sample median outlier confidence regression variance turnout hypothesis",
    "teknologi": "peladen basis data aplikasi csv modul skrip repositori pengembang galat database server developers parser script cache upload queue import maintainer",
    "": "pertemuan dibuka dihadiri hadir ditandatangani papan pengumuman antrean memanjang siang dibahas kesempatan menyinggung beralih perumpamaan attendance signed meeting opened station foot noon morning another matters passing mentioned speaker",
}
#: A topic is named by terms with at least LEAST_MASS of its probability, if NAMED of that belongs to one name.
LEAST_MASS, NAMED = 0.01, 0.5
#: So much of a sentence's modelled words must lie in topics of a subject (or of none) to decide it; else it carries on.
EVIDENCE = 0.25

_NO_WIDTH = re.compile("[­​-‏⁠﻿]")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*+>")
_WORD = r"[^\W\d_][\w\u0300-\u036F]*(?:['’\-][^\W\d_][\w\u0300-\u036F]*)*"
_TOKEN = re.compile(rf"{_WORD}|[.!?…](?=[\s\"'”’)\]<]|$)|\n[^\S\n]*\n")
END, BREAK = BUCKETS, BUCKETS + 1


def fold(word: str) -> str:
    """One spelling for a word and its usual misreadings."""
    word = word.lower().replace("’", "'").replace("1", "l").replace("0", "o").replace("rn", "m")
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def bucket(word: str) -> int:
    return crc32(fold(word).encode("utf-8", "replace")) & (BUCKETS - 1)


class _Codes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= 1 << 19:
            self.clear()
        code = BREAK if token[0] == "\n" else END if len(token) == 1 and not token.isalpha() else bucket(token)
        self[token] = code
        return code


_codes = _Codes()


def read_text(text: str) -> list[str]:
    """Words, sentence ends and paragraph breaks in order."""
    if _NO_WIDTH.search(text):
        text = _NO_WIDTH.sub("", text)
    if "<" in text:
        text = _TAG.sub(lambda m: "\n\n" if m[0][-2:-1] in "pP" or m[0][1:3].lower() in ("br", "di", "li", "h1", "h2", "h3", "/d", "/l", "/h", "td", "tr", "/t") else "", text)
    return _TOKEN.findall(text)


def sentence_arrays(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word buckets, sentence lengths) of one text's codes; the length of what is no running sentence is negative. Empty sentences are left out."""
    marks = np.flatnonzero(codes >= END)
    edges = np.concatenate([marks, [len(codes)]])
    lengths = np.diff(np.concatenate([[-1], edges])) - 1
    running = np.append(codes[marks] == END, False)
    return codes[codes < END], np.where(running, lengths, -lengths)[lengths > 0]


def encode_sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, bag, words, lengths) of every row: the distinct buckets of its words, the place in the bag of each word in order, the lengths of its sentences; binaries of int32."""
    ship_code(documents.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _codes.__getitem__
        for batch in batches:
            bags, words, lengths = [], [], []
            for text in batch.column(1):
                text = text.as_py()
                codes = np.frombuffer(array("i", map(get, read_text(text))), dtype=np.int32) if text else np.zeros(0, np.int32)
                w, n = sentence_arrays(codes)
                bag, at = np.unique(w, return_inverse=True)
                bags.append(bag.astype(np.int32).tobytes())
                words.append(at.astype(np.int32).tobytes())
                lengths.append(n.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.binary()) for x in (bags, words, lengths))], names=["doc_id", "bag", "words", "lengths"])

    return documents.select("doc_id", "text").mapInArrow(rows, "doc_id bigint, bag binary, words binary, lengths binary")


def _ints(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=np.int32)


def word_counts(encoded: DataFrame) -> DataFrame:
    """(bucket, n): how often each bucket is used in all texts."""
    ship_code(encoded.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for bag, words in zip(batch.column(0), batch.column(1), strict=True):
                b = _ints(bag)
                total[b] += np.bincount(_ints(words), minlength=len(b))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    return encoded.select("bag", "words").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


@dataclass
class TopicModel:
    """terms: bucket of each term; phi: term by topic, the topic's probability of the term; weight: share of each topic in all words."""

    terms: np.ndarray
    phi: np.ndarray
    weight: np.ndarray

    def lookup(self) -> np.ndarray:
        table = np.full(BUCKETS, -1, np.int32)
        table[self.terms] = np.arange(len(self.terms), dtype=np.int32)
        return table

    def alpha(self) -> np.ndarray:
        return (ALPHA * len(self.weight) * self.weight).astype(np.float32)


def _raised(terms: np.ndarray, stats: np.ndarray) -> TopicModel:
    """The M-step."""
    phi = stats + ETA
    weight = stats.sum(0) / max(stats.sum(), 1e-9) + 1e-6
    return TopicModel(terms, (phi / np.maximum(phi.sum(0), 1e-9)).astype(np.float32), weight / weight.sum())


def modelled(bag: np.ndarray, words: np.ndarray, lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms of a bag that the model has, their counts, which places of the bag they have)."""
    terms = lookup[bag]
    at = np.flatnonzero(terms >= 0)
    return terms[at], np.bincount(words, minlength=len(bag))[at].astype(np.float32), at


def proportions(like: np.ndarray, counts: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """The topic proportions of a text (times its words) by variational inference, or of each of several. like: its terms' rows of phi."""
    theta = alpha + counts.sum(-1, keepdims=True) / np.float32(len(alpha))
    for _ in range(INNER):
        theta = theta * ((counts / (like @ theta[..., None])[..., 0])[..., None, :] @ like)[..., 0, :] + alpha
    return theta


def grouped(texts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts (terms, counts) in groups of like length: (terms used, text by place among them of each of its terms, counts). The place after the last fills up shorter texts; texts without terms are in no group."""
    for _, filled, terms, counts in alike(texts):
        used, place = np.unique(terms[filled], return_inverse=True)
        at = np.full(filled.shape, len(used), np.int64)
        at[filled] = place
        yield used, at, counts


def alike(texts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts (terms, counts) in groups of like length: (which texts, which cells are filled, terms, counts), text by term."""
    sizes = np.array([len(t) for t, _ in texts], dtype=np.int64)
    order = np.argsort(sizes, kind="stable")[np.count_nonzero(sizes == 0) :]
    first = 0
    while first < len(order):
        last = first + 1
        while last < len(order) and (last + 1 - first) * sizes[order[last]] <= CELLS:
            last += 1
        which, first = order[first:last], last
        filled = np.arange(sizes[which[-1]]) < sizes[which][:, None]
        terms, counts = np.zeros(filled.shape, np.int32), np.zeros(filled.shape, np.float32)
        terms[filled] = np.concatenate([texts[i][0] for i in which])
        counts[filled] = np.concatenate([texts[i][1] for i in which])
        yield which, filled, terms, counts


def group_expectations(groups: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], model: TopicModel) -> tuple[np.ndarray, float, float]:
    """The E-step over groups of texts: expected counts, term by topic, the sum of the bound of the words, and the number of words."""
    phi, alpha = model.phi, model.alpha()
    stats, few = np.zeros(phi.shape), np.zeros(phi.shape, np.float32)
    filling = np.ones((1, phi.shape[1]), np.float32)
    bound = n = 0.0
    for i, (used, at, counts) in enumerate(groups, 1):
        like = np.concatenate([phi.take(used, 0), filling]).take(at, 0)
        theta = proportions(like, counts, alpha)
        mixed = (like @ theta[..., None])[..., 0]
        ratio = np.zeros((len(at), len(used) + 1), np.float32)
        ratio[np.arange(len(at))[:, None], at] = counts / mixed
        few[used] += ratio[:, :-1].T @ theta
        if i % 64 == 0:
            stats += few
            few[:] = 0
        bound += float(np.sum(counts * np.log(mixed / theta.sum(1, keepdims=True)), dtype=np.float64))
        n += float(counts.sum(dtype=np.float64))
    stats += few
    stats *= phi
    return stats, bound, n


def expectations(texts: Iterator[tuple[np.ndarray, np.ndarray]], model: TopicModel) -> tuple[np.ndarray, float, float]:
    """The E-step over texts (terms, counts)."""
    return group_expectations(grouped(list(texts)), model)


def risen(terms: np.ndarray, topics: int, expect: Callable[[TopicModel], tuple[np.ndarray, float, float]]) -> TopicModel:
    """Topics by EM from random ones (of a fixed seed), until the bound stops rising. expect: the E-step."""
    phi = np.random.default_rng(3).gamma(1.0, 1.0, (len(terms), topics)) + 0.1
    model = TopicModel(terms, (phi / np.maximum(phi.sum(0), 1e-9)).astype(np.float32), np.ones(topics) / topics)
    last = -np.inf
    while True:
        stats, bound, n = expect(model)
        model = _raised(terms, stats)
        now = bound / max(n, 1)
        if not n or now - last < RISE * abs(now):
            return model
        last = now


def start_topics(texts: list[tuple[np.ndarray, np.ndarray]], terms: np.ndarray, topics: int) -> TopicModel:
    """Topics of texts that one process holds; `fit_topics` takes the same steps over a table."""
    groups = list(grouped(texts))
    return risen(terms, topics, lambda model: group_expectations(iter(groups), model))


def vocabulary_terms(counts: DataFrame, total: int, vocabulary: int) -> list[int]:
    """The buckets of the model's terms, most frequent first."""
    kept = counts.where((F.col("n") >= LEAST_COUNT) & (F.col("n") <= F.lit(COMMON * total))).orderBy(F.desc("n"), "bucket").limit(vocabulary)
    return [r.bucket for r in kept.select("bucket").collect()]  # a model parameter's size


_GROUP = {"n_texts": pa.int32(), "n_terms": pa.int32(), "used": pa.binary(), "at": pa.binary(), "counts": pa.binary()}


def pack_groups(encoded: DataFrame, terms: np.ndarray) -> DataFrame:
    """The texts of encoded as rows of `grouped`, in the least whole numbers that hold them; every EM step reads them."""
    ship_code(encoded.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = TopicModel(terms, terms, terms).lookup()
        for batch in batches:
            texts = [modelled(_ints(bag), _ints(words), lookup)[:2] for bag, words in zip(batch.column(0), batch.column(1), strict=True)]
            rows = [(*at.shape, used.astype(np.int32).tobytes(), *(x.astype(np.min_scalar_type(int(x.max()))).tobytes() for x in (at, counts))) for used, at, counts in grouped(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), _GROUP.values(), strict=True)] if rows else [pa.array([], kind) for kind in _GROUP.values()], names=list(_GROUP))

    return encoded.select("bag", "words").mapInArrow(pack, "n_texts int, n_terms int, used binary, at binary, counts binary")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of `pack_groups` as groups."""
    for batch in batches:
        for n, m, used, at, counts in zip(*(batch.column(name) for name in _GROUP), strict=True):
            shape = n.as_py(), m.as_py()
            at, counts = (np.frombuffer(b := x.as_buffer(), dtype=f"u{b.size // (shape[0] * shape[1])}").reshape(shape) for x in (at, counts))
            yield _ints(used), at.astype(np.int64), counts.astype(np.float32)


def _added(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), dtype=np.int64) for x in table.column("parts"))
    return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "parts": pa.array([total.tobytes()], pa.binary())})


def all_expectations(packed: DataFrame, model: TopicModel) -> tuple[np.ndarray, float, float]:
    """The E-step over all texts. Each core adds up its texts' expectations, so what is shuffled follows the cores and the model."""
    sc = packed.sparkSession.sparkContext
    shared = sc.broadcast(model)  # vocabulary x topics, whatever the corpus

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, bound, n = group_expectations(_groups(batches), shared.value)
        parts = np.append(stats, [bound, n])
        parts *= PARTS
        parts = np.rint(parts, out=parts).astype(np.int64)
        pieces = range(-(-len(parts) // PIECE))
        yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.int32()), pa.array([parts[i * PIECE : (i + 1) * PIECE].tobytes() for i in pieces], pa.binary())], names=["piece", "parts"])

    schema = "piece int, parts binary"
    cores = max(sc.defaultParallelism, 1)
    sums = packed.coalesce(cores).mapInArrow(partial, schema).repartition(-(-cores // 8), "piece")  # a task adds up the sums of eight cores: starting one costs more
    found = sums.groupBy("piece").applyInArrow(_added, schema).collect()  # the size of the model
    shared.destroy()
    whole = np.frombuffer(b"".join(r.parts for r in sorted(found, key=lambda r: r.piece)), dtype=np.int64) / PARTS
    return (whole[:-2].reshape(model.phi.shape), *whole[-2:].tolist()) if len(whole) else (np.zeros(model.phi.shape), 0.0, 0.0)


def fit_topics(encoded: DataFrame, vocabulary: int = VOCABULARY, topics: int = TOPICS) -> TopicModel:
    """The topic model of all texts. encoded is read several times; it should be cut first."""
    counts = cut(word_counts(encoded))
    total = counts.agg(F.sum("n")).first()[0] or 0
    terms = np.array(vocabulary_terms(counts, total, vocabulary), dtype=np.int64)
    packed = cut(pack_groups(encoded, terms))
    return risen(terms, topics, lambda model: all_expectations(packed, model))


def areas_of(areas: DataFrame) -> dict[str, list[int]]:
    """The buckets of the terms that name each subject of the table of areas (subject, title_id, title_en), in order of name, and last of none ("")."""
    titles = {r.subject: f"{r.title_id or ''} {r.title_en or ''}" for r in areas.select("subject", "title_id", "title_en").where("subject IS NOT NULL").collect()}  # a fixed table
    named = {s: INSPECTED[s].split() if s in INSPECTED else [w for w in re.findall(_WORD, titles[s]) if len(w) > 3] for s in sorted(titles)}
    return {s: sorted({bucket(w) for w in words}) for s, words in (named | {"": INSPECTED[""].split()}).items()}


def topic_subjects(model: TopicModel, areas: dict[str, list[int]]) -> np.ndarray:
    """The name of each topic as an index into areas; len(areas) for common wording."""
    lookup = model.lookup()
    mass = np.stack([model.phi[[i for i in lookup[buckets] if i >= 0]].sum(0) for buckets in areas.values()])
    best = mass.argmax(0)
    known = (mass.max(0) >= LEAST_MASS) & (mass.max(0) >= NAMED * mass.sum(0))
    return np.where(known, best, len(areas))


def sentence_kinds(mass: np.ndarray) -> np.ndarray:
    """The kind of each sentence, from the share of its words in (subjects…, none, common wording): a subject's index, that of none, or that of common wording where it carries on."""
    none = mass.shape[1] - 2
    total = mass.sum(1)
    best = mass[:, :none].argmax(1) if none else np.zeros(len(mass), np.int64)
    most = mass[np.arange(len(mass)), best] if none else np.zeros(len(mass))
    least = np.maximum(EVIDENCE * total, 1e-6)
    own = (most >= least) & (most >= mass[:, none])
    return np.where(own, best, np.where(mass[:, none] >= least, none, none + 1))


def carried(kinds: np.ndarray, none: int, first: np.ndarray | int = 0) -> np.ndarray:
    """The kinds of the running sentences, those that carry on replaced by that of the sentence before in the text. first: where the text of each sentence begins."""
    source = np.maximum.accumulate(np.where(kinds <= none, np.arange(len(kinds)), first))
    return kinds[source]


def texts_subjects(bags: list[np.ndarray], words: list[np.ndarray], lengths: list[np.ndarray], model: TopicModel, lookup: np.ndarray, alpha: np.ndarray, named: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(running sentences of each subject, running sentences) of each text. named: topic by kind, 1 where the topic has the kind."""
    n, none = len(bags), named.shape[1] - 2
    size = np.array([len(b) for b in bags])
    place = np.cumsum(size) - size
    word = np.concatenate(words) + np.repeat(place, [len(w) for w in words])
    terms, counts, at = modelled(np.concatenate(bags), word, lookup)
    ends = np.searchsorted(at, place + size)
    begins = np.searchsorted(at, place)
    kind = np.zeros((int(size.sum()), none + 2), np.float32)
    for which, filled, some, uses in alike([(terms[i:j], counts[i:j]) for i, j in zip(begins, ends, strict=True)]):
        like = model.phi.take(some, 0)
        theta = proportions(like, uses, alpha)
        share = ((like * theta[:, None, :]) @ named) / (like @ theta[..., None])
        kind[at[(begins[which][:, None] + np.arange(filled.shape[1]))[filled]]] = share[filled]
    length = np.concatenate(lengths)
    running = length > 0
    text = np.repeat(np.arange(n), [len(x) for x in lengths])[running]
    total = np.bincount(text, minlength=n)
    if not len(text):
        return np.zeros((n, none), np.int64), total
    mass = np.add.reduceat(kind.take(word, 0), np.cumsum(np.abs(length)) - np.abs(length), axis=0)
    final = carried(sentence_kinds(mass[running]), none, (np.cumsum(total) - total)[text])
    own = final < none
    return np.bincount(text[own] * none + final[own], minlength=n * none).reshape(n, none), total


def assign_subjects(encoded: DataFrame, model: TopicModel, areas: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, subject, share): the subjects of each row, with their share of the running sentences."""
    ship_code(encoded.sparkSession)
    known = areas_of(areas)
    subjects = list(known)[:-1]
    named = np.eye(len(known) + 1, dtype=np.float32)[topic_subjects(model, known)]
    shared = encoded.sparkSession.sparkContext.broadcast((model, named))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, named = shared.value
        lookup, alpha = model.lookup(), model.alpha()
        for batch in batches:
            texts = [[_ints(x) for x in batch.column(k)] for k in (1, 2, 3)]
            part = np.cumsum([len(w) for w in texts[1]]) // WORDS
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
            for i, j in zip(edges, edges[1:], strict=False):
                if i == j:
                    continue
                found, n = texts_subjects(*(x[i:j] for x in texts), model, lookup, alpha, named)
                row, k = np.nonzero((found > 0) & (found >= share * n[:, None]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + i)), pa.array([subjects[x] for x in k], pa.string()), pa.array(found[row, k] / n[row], pa.float64())], names=["doc_id", "subject", "share"])

    return encoded.select("doc_id", "bag", "words", "lengths").mapInArrow(assign, "doc_id bigint, subject string, share double")


def topic_terms(documents: DataFrame, model: TopicModel, areas: DataFrame, top: int = 20) -> DataFrame:
    """(topic, subject, rank, term, probability): the top terms of each topic, spelled as most often in the texts; subject is the topic's name, empty for none, null for common wording."""
    spark = documents.sparkSession
    known = areas_of(areas)
    names = [*known, None]
    kinds = topic_subjects(model, known)
    best = [(k, names[kinds[k]], r + 1, int(model.terms[i]), float(model.phi[i, k])) for k in range(model.phi.shape[1]) for r, i in enumerate(np.argsort(-model.phi[:, k])[:top])]
    wanted = spark.createDataFrame(best, "topic int, subject string, rank int, bucket bigint, probability double")
    buckets = {b for *_, b, _ in best}

    def spellings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            for text in batch.column(0):
                for token in read_text(text.as_py() or ""):
                    if _codes[token] in buckets:
                        word = fold(token)
                        seen[word] = seen.get(word, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([bucket(w) for w in seen], pa.int64()), pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["bucket", "term", "n"])

    words = documents.select("text").mapInArrow(spellings, "bucket bigint, term string, n bigint").groupBy("bucket", "term").agg(F.sum("n").alias("n"))
    named = words.groupBy("bucket").agg(F.max_by("term", F.struct("n", "term")).alias("term"))
    return wanted.join(named, "bucket").select("topic", "subject", "rank", "term", "probability")


def composition(assigned: DataFrame, areas: DataFrame) -> DataFrame:
    """(subject, n_documents, sum_share) of every subject area, those without documents included."""
    n = assigned.groupBy("subject").agg(F.count("*").alias("n"), F.sum("share").alias("s"))
    joined = areas.select("subject").join(n, "subject", "left")
    return joined.select("subject", F.coalesce("n", F.lit(0)).alias("n_documents"), F.coalesce("s", F.lit(0.0)).alias("sum_share"))
