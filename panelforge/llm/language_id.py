"""Language identification by Bayesian evidence fusion.

Three kinds of evidence are added in log space: the text's likelihood under byte-trigram models
of the languages, the language that the markup declares, and a prior for the host. Host priors
come from grouped aggregation of the texts' own posteriors and are smoothed in three levels:
host towards parent domain, parent domain towards address suffix, suffix towards all documents,
each with a strength in documents. What a suffix says is thus counted and not listed. A
document's own share is taken out of its host's, domain's and suffix's counts.

A background model, by which all trigrams are equally likely, stands for everything that is in
none of the known languages. It has a small prior share, and its documents are not kept.

The models are counted over all labelled rows, and every label is a language. The model that
tasks hold stays below most_bytes: with more languages it has fewer bins.

Defined results: texts without letters have no likelihood evidence; null or unknown declared
languages and null hosts add nothing; without any evidence, or if the background wins, the
language is null and the document is not kept; ties go to the language first in order; repeated
rows each count; very long texts are read in blocks of whole texts; an empty table gives an
empty table; added columns get a leading underscore if the table has their name. Without any
labelled row every document is kept, as nothing can be said against it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, stored, table, text_or_empty

BINS = 1 << 15
_BLOCK_BYTES, _ROWS = 250_000, 1000
#: Bytes that a trigram may hold: letters, and one space for everything else.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)

def _trigrams(texts: list[str | None], bins: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, rows, then bin and row of each trigram, for blocks of bounded size."""
    at, part, held = 0, [], 0
    for k, text in enumerate(texts):
        part.append((text or "").encode())
        held += len(part[-1]) + 2
        if held > _BLOCK_BYTES or k == len(texts) - 1:
            size = np.fromiter(map(len, part), np.int64, len(part)) + 2
            # two spaces stand before each text, so no trigram holds letters of two texts
            b = _FOLD[np.frombuffer(b"  " + b"  ".join(part) + b"  ", np.uint8)].astype(np.uint32)
            code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
            row = np.repeat(np.arange(len(part), dtype=np.int32), size)[: len(code)]
            solid = (b[:-2] != 32) | (b[1:-1] != 32)
            code, row = code[solid], row[solid]
            yield at, len(part), ((code * np.uint32(0x9E3779B1)) >> np.uint32(17)) % np.uint32(bins), row
            at, part, held = k + 1, [], 0


def _counting(languages: list[str], bins: int):
    place = {x: k for k, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(languages) * bins, np.int64)
        parts = (batch.slice(k, _ROWS) for batch in batches for k in range(0, batch.num_rows, _ROWS))
        for part in parts:
            language = np.array([place[x] for x in part.column(1).to_pylist()], np.int64)
            for at, n, bin_of, row in _trigrams(part.column(0).to_pylist(), bins):
                counts += np.bincount(language[at : at + n][row] * bins + bin_of, minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(seen), "n": pa.array(counts[seen])})

    return run


class Model:
    """Languages, their shares, and log p(bin | language) as an array bins x languages."""

    def __init__(self, languages: list[str], shares: list[float], table_of: np.ndarray):
        self.languages, self.shares, self.table = languages, shares, table_of


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", bins: int = BINS, most_bytes: int = 64 << 20) -> Model:
    """Every label is a language; bins are halved until the model is within most_bytes."""
    labelled = labelled.where(F.col(label).isNotNull() & (F.col(label) != "")).select(text_or_empty(text).alias("text"), F.col(label).cast("string").alias("label"))
    rows = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").collect()  # a row for each language
    languages = [r["label"] for r in rows]
    while bins > 1024 and bins * len(languages) * 4 > most_bytes:
        bins //= 2
    if not languages:
        return Model([], [], np.zeros((bins, 0), np.float32))
    sums = labelled.mapInArrow(_counting(languages, bins), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow().to_pandas()  # bins x languages
    cells = np.zeros(len(languages) * bins)
    cells[sums["cell"]] = sums["n"]
    grid = cells.reshape(len(languages), bins).T + 0.5
    seen = sum(r["n"] for r in rows)
    return Model(languages, [r["n"] / seen for r in rows], np.log(grid / grid.sum(axis=0)).astype(np.float32))


def likelihoods(model: Model, temper: float):
    """Log likelihood of a text under each language and the background, times temper (trigrams overlap)."""
    log_p, bins = model.table, len(model.table)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def log_likelihoods(texts: pd.Series) -> pd.Series:
        out = np.zeros((len(texts), log_p.shape[1] + 1))
        for at, n, bin_of, row in _trigrams(texts.tolist(), bins):
            for k in range(log_p.shape[1]):
                out[at : at + n, k] = np.bincount(row, log_p[bin_of, k], n)
            out[at : at + n, -1] = np.bincount(row, minlength=n) * -np.log(bins)
        return pd.Series(list(out * temper), dtype=object)

    # Else a filter on what follows from it would have it worked out a second time.
    return log_likelihoods.asNondeterministic()


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _posterior(logs: Column) -> Column:
    def weighed(x: Column) -> Column:
        return _let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))

    def shared(weights: Column) -> Column:
        return _let(F.aggregate(weights, F.lit(0.0), lambda a, v: a + v), lambda total: F.transform(weights, lambda v: v / total))

    return _let(_let(logs, weighed), shared)


def _added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def identify(
    df: DataFrame,
    model: Model,
    text: str = "text",
    host: str | None = None,
    declared: str | Column | None = None,
    temper: float = 1 / 3,
    trust_declared: float = 0.9,
    strength: float = 5.0,
    unknown: float = 1e-3,
    least: float = 0.5,
    most_cells: int = 1_000_000,
) -> DataFrame:
    """df's rows with lang_id, lang_p (its posterior) and lang_kept (lang_p > least).

    unknown: prior share of text in none of the languages. Host priors are broadcast if hosts
    times languages are at most most_cells, else joined by a shuffle.
    """
    logs = free_name(df, "text_logs")
    out = fuse(df.withColumn(logs, likelihoods(model, temper)(text_or_empty(text))), logs, model, host, declared, trust_declared, strength, unknown, least, most_cells)
    return out.drop(logs)


def fuse(df: DataFrame, logs: str, model: Model, host: str | None, declared: str | Column | None, trust_declared: float = 0.9, strength: float = 5.0, unknown: float = 1e-3, least: float = 0.5, most_cells: int = 1_000_000) -> DataFrame:
    """The same for rows that have their text's log likelihoods in column logs."""
    lang_id, lang_p, lang_kept = (free_name(df, c) for c in ("lang_id", "lang_p", "lang_kept"))
    n = len(model.languages)
    if not n:
        return df.withColumns({lang_id: F.lit(None).cast("string"), lang_p: F.lit(None).cast("double"), lang_kept: F.lit(True)})
    own, of, joined_host, result = (free_name(df, c) for c in ("text_own", "host_of", "joined_host", "lang_result"))
    levels = [free_name(df, c) for c in ("host_sums", "parent_sums", "suffix_sums")]
    shares = F.array(*[F.lit(p * (1 - unknown)) for p in model.shares], F.lit(unknown))
    languages = F.array(*map(F.lit, model.languages))
    name = F.lower(F.col(host).cast("string")) if host else F.lit(None).cast("string")
    scored = df.withColumn(own, _posterior(F.zip_with(logs, shares, lambda x, p: x + F.log(p)))).withColumn(of, name)

    def summed(column: str) -> Column:
        return F.array(*[F.sum(F.get(F.col(column), F.lit(k))) for k in range(n + 1)])

    hosts = scored.where(F.col(of).isNotNull()).groupBy(F.col(of).alias(joined_host)).agg(summed(own).alias(levels[0]))
    hosts = stored(hosts.withColumns({"parent": F.regexp_extract(joined_host, r"([^.]+\.[^.]+)$", 1), "suffix": F.regexp_extract(joined_host, r"\.([^.]+)$", 1)}))
    parents = hosts.groupBy("parent").agg(summed(levels[0]).alias(levels[1]))
    suffixes = hosts.groupBy("suffix").agg(summed(levels[0]).alias(levels[2]))
    priors = stored(hosts.join(parents, "parent").join(suffixes, "suffix").drop("parent", "suffix"))
    small = priors.count() * (n + 1) <= most_cells
    joined = scored.join(F.broadcast(priors) if small else priors, F.col(of) == F.col(joined_host), "left")

    def towards(counts: Column, wider: Column) -> Column:
        return _let(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x), lambda total: F.zip_with(counts, wider, lambda c, p: (c + strength * p) / (total + strength)))

    def host_prior(mine: Column) -> Column:
        others = [F.zip_with(sums, mine, lambda c, p: F.greatest(c - p, F.lit(0.0))) for sums in levels]
        wider = shares
        for counts in reversed(others):
            wider = towards(counts, wider)
        return F.when(F.col(joined_host).isNull(), shares).otherwise(wider)

    nothing = F.aggregate(logs, F.lit(0.0), lambda a, x: a + F.abs(x)) == 0
    evidence = F.lit(None)
    if declared is not None:
        said = F.lower(F.substring_index((F.col(declared) if isinstance(declared, str) else declared).cast("string"), "-", 1))
        # trust for the language that is named, the rest shared by the others
        named = F.transform(F.concat(languages, F.array(F.lit(""))), lambda x: F.when(x == said, float(np.log(trust_declared))).otherwise(float(np.log((1 - trust_declared) / n))))
        names_one = F.coalesce(F.array_contains(languages, said), F.lit(False))
        nothing, evidence = nothing & ~names_one, F.when(names_one, named)

    def decided(posterior: Column) -> Column:
        best = F.array_max(F.slice(posterior, 1, n))
        found = F.get(languages, (F.array_position(posterior, best) - 1).cast("int"))
        sure = ~nothing & (best >= F.get(posterior, F.lit(n)))
        return F.struct(F.when(sure, found).alias("id"), F.when(~nothing, best).alias("p"), (~nothing & (best > least)).alias("kept"))

    # Each step is bound to a name, as the optimizer would write it out wherever it is used.
    prior = host_prior(F.col(own))
    text_and_host = F.zip_with(logs, prior, lambda x, p: x + F.log(F.greatest(p, F.lit(1e-12))))
    fused = _let(text_and_host, lambda x: F.coalesce(_added(x, evidence), x)) if declared is not None else text_and_host
    out = joined.withColumn(result, _let(_posterior(fused), decided))
    return out.withColumns({lang_id: F.col(f"{result}.id"), lang_p: F.col(f"{result}.p"), lang_kept: F.col(f"{result}.kept")}).drop(own, of, joined_host, result, *levels)


def declared_in(text: str) -> Column:
    """The language that the markup in a text declares, null if none does."""
    return F.nullif(F.regexp_extract(text, r"(?i)<html[^>]*\blang=[\"']?([A-Za-z-]+)", 1), F.lit(""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all documents; sources stand for hosts, labels train the text models. Of the kinds of
    evidence, declared language and suffix act where texts hold markup and sources are addresses."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    scored = stored(docs.select("doc_id", "source", declared_in("text").alias("said"), likelihoods(model, 1 / 3)(text_or_empty("text")).alias("logs")))
    found = fuse(scored, "logs", model, host="source", declared="said")
    return found.select("doc_id", F.col("lang_id").alias("lang"), F.col("lang_p").alias("posterior"), F.col("lang_kept").alias("kept"))


def page_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All web pages: text, declared language, address suffix and host together."""
    pages = table(spark, sf_dir, "pages")
    body = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    model = fit(table(spark, sf_dir, "documents"))
    pages = pages.select("page_id", body.alias("text"), declared_in("html").alias("said"), F.regexp_extract("url", r"^[a-z]+://(?:[^/@]*@)?([^/:?#]+)", 1).alias("host"))
    found = identify(pages, model, host="host", declared="said")
    return found.select("page_id", "host", "said", F.col("lang_id").alias("lang"), F.col("lang_p").alias("posterior"), F.col("lang_kept").alias("kept"))
