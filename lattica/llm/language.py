"""Missing or wrong language labels, and texts that mix languages."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.canonical import trimmed
from lattica.llm.sentences import is_end, is_ideograph, tokens
from lattica.session import settle, small_side

# Each language's codes of two and three letters and its English name
LANGUAGES = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german"),
    "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish"),
    "pt": ("pt", "por", "portuguese"),
    "ru": ("ru", "rus", "russian"),
    "uk": ("uk", "ukr", "ukrainian"),
    "zh": ("zh", "zho", "chi", "chinese"),
}
CODES = list(LANGUAGES)
#: Words a piece of text needs to count as a whole sentence; an ideograph is half a word.
LEAST_WORDS = 4


def label_language(c: Column) -> Column:
    """The language that a label names in any usual spelling (code, locale, English name), else null."""
    low = F.lower(trimmed(c))
    head = F.regexp_extract(low, r"^([a-z]+)(?:$|[^a-z])", 1)
    out = None
    for code, spellings in LANGUAGES.items():
        out = F.when(head.isin(*spellings), code) if out is None else out.when(head.isin(*spellings), code)
    return out


class TextModel:
    """Likelihood of words in each language: word counts, backed by a model of three-letter sequences."""

    def __init__(self, counts: list[Counter], top_words: int = 200_000):
        every = Counter()
        for c in counts:
            every.update(c)
        self.words = {w: [c[w] for c in counts] for w, _ in every.most_common(top_words)}
        self.total = [max(1, sum(c.values())) for c in counts]
        self.tri: list[Counter] = []
        self.bi: list[Counter] = []
        for c in counts:
            tri, bi = Counter(), Counter()
            for w, n in c.items():
                s = f"  {w} "
                for i in range(len(s) - 2):
                    tri[s[i : i + 3]] += n
                    bi[s[i : i + 2]] += n
            self.tri.append(tri)
            self.bi.append(bi)
        self.letters = len({ch for w in self.words for ch in w}) + 1

    def vector(self, word: str) -> np.ndarray:
        """Log-likelihood of a word in each language, less the best one's; at most 10 apart."""
        s = f"  {word} "
        out = []
        seen = self.words.get(word)
        for k in range(len(self.total)):
            spelt = 0.0
            for i in range(len(s) - 2):
                spelt += math.log((self.tri[k][s[i : i + 3]] + 0.5) / (self.bi[k][s[i : i + 2]] + 0.5 * self.letters))
            out.append(math.log(0.9 * (seen[k] / self.total[k] if seen else 0.0) + 0.1 * math.exp(spelt) + 1e-300))
        v = np.array(out) - max(out)
        return np.maximum(v, -10.0 if seen else -3.0).astype(np.float32)


def _below(share: float) -> Column:
    """Whether a document's hash lies in the lowest share of all 64-bit numbers: as fine as the hash, however small the share."""
    return F.xxhash64("doc_id") <= F.lit(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))


def fit(documents: DataFrame, sample_documents: int = 4000, longest_chars: int = 50_000, most_chars: int = 40_000_000) -> TextModel:
    """A text model from a bounded sample of labelled rows (doc_id, text, label).

    The sample is about sample_documents labelled texts, of up to longest_chars characters each and about
    most_chars in all: those whose hash of the id falls below the share that gives so many (never more than
    twice as many), so what reaches the driver doesn't grow with the data; wrong labels among them only blur
    the counts. Everything after the fit covers all rows and whole texts. Without labelled rows the model
    knows nothing; ValueError if there are labelled rows but the sample got none of them.
    """
    language = label_language(F.col("label"))
    labelled = documents.where(language.isNotNull()).count()
    share = min(1.0, sample_documents / max(1, labelled))
    usable = documents.where(language.isNotNull() & (F.length("text") <= longest_chars))
    sample = settle(usable.where(_below(share)).select("doc_id", "text", language.alias("l")).limit(2 * sample_documents))
    chars = sample.agg(F.sum(F.length("text"))).first()[0] or 0
    rows = sample.where(_below(share * min(1.0, most_chars / max(1, chars)))).select("text", "l").collect()
    if labelled and not rows:
        raise ValueError(f"none of {labelled} labelled texts is in the sample: raise sample_documents, longest_chars or most_chars")
    counts = [Counter() for _ in CODES]
    for r in rows:
        counts[CODES.index(r["l"])].update(t for t in tokens(r["text"]) if not is_end(t))
    return TextModel(counts)


class _Scorer:
    """Scores batches of texts; the vectors of words met are kept, up to a bound."""

    KEEP = 400_000

    def __init__(self, model: TextModel):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.vectors = np.zeros((1024, len(CODES)), dtype=np.float32)
        self.weight = np.zeros(1024, dtype=np.float32)
        self.n = 1  # row 0: an end of a sentence

    def _new(self, token: str) -> int:
        if is_end(token):
            self.ids[token] = 0
            return 0
        if self.n == len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            self.weight = np.concatenate([self.weight, np.zeros_like(self.weight)])
        i = self.n
        self.vectors[i] = self.model.vector(token)
        self.weight[i] = 0.5 if is_ideograph(token) else 1.0
        self.ids[token] = i
        self.n += 1
        return i

    def score(self, texts: list[list[str]]) -> list[tuple]:
        """For each text (as tokens) its stretches: runs of whole sentences of one likeliest language."""
        if self.n > self.KEEP:
            self._reset()
        known, new = self.ids.get, self._new
        flat: list[int] = []
        owners: list[int] = []
        for toks in texts:
            for t in toks:
                i = known(t)
                flat.append(new(t) if i is None else i)
            flat.append(0)
            owners.append(len(flat))
        ids = np.array(flat, dtype=np.int64)
        stops = np.flatnonzero(ids == 0)
        starts = np.concatenate([[0], stops[:-1] + 1])
        # row 0 is zero, so the stop itself adds nothing; reduceat needs starts < len
        sums = np.add.reduceat(self.vectors[ids], starts, axis=0)
        words = np.add.reduceat(self.weight[ids], starts)
        whole = words >= LEAST_WORDS
        best = sums.argmax(axis=1)
        keep = np.flatnonzero(whole)
        out: list[list[tuple]] = [[] for _ in texts]
        if not len(keep):
            return out
        d, b = np.searchsorted(np.array(owners), stops[keep], side="right"), best[keep]
        first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (b[1:] != b[:-1])]))
        ll = np.add.reduceat(sums[keep], first, axis=0)
        n_words = np.add.reduceat(words[keep], first)
        n_sent = np.diff(np.concatenate([first, [len(keep)]]))
        for j, f in enumerate(first.tolist()):
            out[int(d[f])].append((int(b[f]), int(n_sent[j]), float(n_words[j]), ll[j].tolist()))
        return out


_STRETCHES = "array<struct<best:int,sentences:int,words:double,ll:array<double>>>"


def stretches(documents: DataFrame, model: TextModel) -> DataFrame:
    """(doc_id, label, source, stretches) of all documents (doc_id, text, label, source) with a non-blank text.

    stretches holds the runs of whole sentences with the same likeliest language, in the order of the text,
    with their numbers of sentences and words and the log-likelihood of each language. A map over whole
    texts without any shuffle; what comes out is a few numbers a document.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(model)
        for pdf in batches:
            texts, size, found = [], 0, []
            for text in pdf["text"].tolist():
                texts.append(tokens(text))
                size += len(texts[-1])
                if size > 400_000:
                    found += scorer.score(texts)
                    texts, size = [], 0
            if texts:
                found += scorer.score(texts)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "source": pdf["source"], "stretches": [[dict(zip(("best", "sentences", "words", "ll"), s)) for s in x] for x in found]})

    kind = documents.schema["doc_id"].dataType.simpleString()
    slim = documents.select("doc_id", "text", F.col("label").cast("string").alias("label"), F.col("source").cast("string").alias("source"))
    return slim.where(trimmed(F.col("text")) != "").mapInPandas(run, f"doc_id {kind}, label string, source string, stretches {_STRETCHES}")


def _spread(pairs: DataFrame, column: str) -> list[list[float]]:
    """log P(value of column | language), the last row standing for no language named; 9 rows at most are read."""
    n = len(CODES)
    counts = np.full((n + 1, n), 1.0)
    for r in pairs.groupBy("main", column).agg(F.count("*").alias("n")).collect():
        counts[CODES.index(r[column]) if r[column] else n, r["main"]] += r["n"]
    return np.log(counts / counts.sum(axis=0)).tolist()


def _row_of(table: list[list[float]], value: Column) -> Column:
    out = F.array(*[F.lit(x) for x in table[-1]])
    cases = None
    for code, row in zip(CODES, table):
        cell = F.array(*[F.lit(x) for x in row])
        cases = F.when(value == code, cell) if cases is None else cases.when(value == code, cell)
    return cases.otherwise(out)


def identify(documents: DataFrame, model: TextModel | None = None, smoothing: float = 20.0) -> DataFrame:
    """The language of each stretch of each document, by fusion of evidence.

    documents: (doc_id, text, label, source). Result: (doc_id, label_lang, stretch, lang, confidence,
    sentences, words), stretch counting from 0 in the order of the text. Documents without a whole sentence
    have no row.
    Evidence, multiplied as Bayes' rule has it: the text likelihood of the stretch; how often documents of
    a language carry such a label, and such a language suffix of the address (both learned from all
    documents by grouped counts); and a prior of the host that is smoothed hierarchically, the document's
    other stretches over the whole address over its first part over the corpus. confidence is the
    posterior probability.
    Defined cases: null, empty and blank texts yield nothing; null labels and sources are evidence of their
    own ("none named"); repeated documents yield their rows again; ids may be of any type; an empty table
    yields no rows. Other columns are not read.

    Scale: texts are read once and never shuffled. All counts are over all documents. What is collected is
    at most 9 x 8 numbers for labels and suffixes; the hosts' table is broadcast only if counted small.
    """
    if model is None:
        model = fit(documents)
    n = len(CODES)
    suffix = label_language(F.regexp_extract(F.lower("source"), r"[./_-]([a-z]{2,3}(?:[-_][a-z]{2})?)/?$", 1))
    main = F.expr(f"array_position(transform(sequence(0, {n - 1}), l -> aggregate(filter(stretches, s -> s.best = l), 0d, (a, s) -> a + s.words)), array_max(transform(sequence(0, {n - 1}), l -> aggregate(filter(stretches, s -> s.best = l), 0d, (a, s) -> a + s.words)))) - 1").cast("int")
    scored = settle(
        stretches(documents, model)
        .where(F.size("stretches") > 0)
        .select("doc_id", label_language(F.col("label")).alias("label_lang"), F.coalesce("source", F.lit("")).alias("host"), suffix.alias("suffix"), "stretches")
        .withColumn("main", main)
    )
    parent = F.regexp_extract("host", r"^(?:[a-z]+://)?([^/]*)", 1)
    by_host = scored.groupBy("host", "main").agg(F.count("*").alias("n"))
    cells = F.array(*[F.sum(F.when(F.col("main") == k, F.col("n")).otherwise(0)).cast("double") for k in range(n)])
    hosts = by_host.groupBy("host").agg(cells.alias("c")).withColumn("parent", parent)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    smooth = lambda c, p: F.zip_with(c, p, lambda x, y: (x + smoothing * y) / (total(c) + smoothing))
    corpus = scored.groupBy("main").agg(F.count("*").alias("n")).collect()
    base = np.ones(n)
    for r in corpus:
        base[r["main"]] += r["n"]
    base_column = F.array(*[F.lit(float(x)) for x in base / base.sum()])
    parents = by_host.withColumn("parent", parent).groupBy("parent").agg(cells.alias("c")).select("parent", smooth(F.col("c"), base_column).alias("pp"))
    priors = hosts.join(parents, "parent").select("host", smooth(F.col("c"), F.col("pp")).alias("prior"))
    labels, suffixes = _spread(scored, "label_lang"), _spread(scored, "suffix")

    each = scored.join(small_side(priors), "host").select("*", F.posexplode("stretches").alias("stretch", "s"))
    own = F.expr(f"transform(sequence(0, {n - 1}), l -> aggregate(filter(stretches, x -> x.best = l), 0d, (a, x) -> a + x.words) - if(s.best = l, s.words, 0d))")
    prior = smooth(own, F.col("prior"))
    logs = F.zip_with(F.zip_with("s.ll", prior, lambda a, p: a + F.log(p)), F.zip_with(_row_of(labels, F.col("label_lang")), _row_of(suffixes, F.col("suffix")), lambda a, b: a + b), lambda a, b: a + b)
    return (
        each.select("doc_id", "label_lang", "stretch", "s", logs.alias("logs"))
        .withColumn("top", F.array_max("logs"))
        .select(
            "doc_id", "label_lang", "stretch",
            F.element_at(F.array(*[F.lit(c) for c in CODES]), F.array_position("logs", F.col("top")).cast("int")).alias("lang"),
            (1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))).alias("confidence"),
            F.col("s.sentences").alias("sentences"), F.col("s.words").alias("words"),
        )
    )


def mislabelled(identified: DataFrame) -> DataFrame:
    """(doc_id, lang) for each language with a whole sentence, of documents whose label is missing or wrong or that mix languages."""
    langs = identified.groupBy("doc_id").agg(F.collect_set("lang").alias("langs"), F.first("label_lang").alias("label_lang"))
    wrong = F.col("label_lang").isNull() | (F.size("langs") > 1) | (F.element_at("langs", 1) != F.col("label_lang"))
    return langs.where(wrong).select("doc_id", F.explode("langs").alias("lang"))
