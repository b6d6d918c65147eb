"""Keyword search over documents: analysis, postings, relevance, cut-offs and fuzzy terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaywise.functions.stemming import stems

#: English stop words of the standard analyser: fixed values.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def without_stop_words(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def analyse(text: Column) -> Column:
    """Tokens without stop words; stems are looked up where postings or query terms are built."""
    return without_stop_words(tokens(text))


def with_synonyms(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """``query_id, term, variant``: each query term with itself and its synonyms (``term, synonym``)."""
    both = synonyms.select("term", F.col("synonym").alias("variant"))
    own = queries.select("query_id", "term", F.col("term").alias("variant"))
    return own.unionByName(queries.join(both, "term").select("query_id", "term", "variant")).distinct()


def phrase_synonyms(queries: DataFrame, phrases: DataFrame, longest: int = 4) -> DataFrame:
    """``query_id, slot, variant``: the words of queries (``query_id, words``) in slots, each with all that may stand there.

    ``phrases`` (``phrase, meaning``) lists words and phrases of up to ``longest`` words; those of one meaning stand for each
    other. Runs of words meet the table by an equi join. From left to right the longest phrase takes its words, so
    slots do not overlap; a word in no phrase is a slot of its own.
    """
    spans = F.flatten(F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("words") - i)), lambda n: F.struct(i.alias("at"), n.alias("n")))))
    runs = queries.where(F.size("words") > 0).select("query_id", "words", F.explode(spans).alias("s"))
    runs = runs.select("query_id", "s.at", "s.n", F.array_join(F.slice("words", F.col("s.at") + 1, F.col("s.n")), " ").alias("phrase"))
    table = phrases.select(F.lower("phrase").alias("phrase"), "meaning").distinct()
    found = runs.join(sent_if_small(table), "phrase", "left").where((F.col("n") == 1) | F.col("meaning").isNotNull())

    spot = F.struct("at", (-F.col("n")).alias("less"), "n", "phrase")
    ordered = found.groupBy("query_id").agg(F.array_sort(F.collect_set(spot)).alias("spots"))
    empty = F.struct(F.lit(0).alias("end"), F.expr("cast(array() as array<struct<at:int,phrase:string>>)").alias("kept"))
    taken = lambda acc, x: F.when(x["at"] >= acc["end"], F.struct((x["at"] + x["n"]).alias("end"), F.concat(acc["kept"], F.array(F.struct(x["at"].alias("at"), x["phrase"].alias("phrase")))).alias("kept"))).otherwise(acc)
    kept = ordered.select("query_id", F.posexplode(F.aggregate("spots", empty, taken, lambda acc: acc["kept"])).alias("slot", "k")).select("query_id", "slot", "k.phrase")
    meant = kept.join(sent_if_small(table), "phrase")
    others = meant.join(sent_if_small(table.withColumnRenamed("phrase", "variant")), "meaning").select("query_id", "slot", "variant")
    return kept.select("query_id", "slot", F.col("phrase").alias("variant")).unionByName(others).distinct()


def postings(docs: DataFrame, key: str, text: str, stem: bool = False) -> DataFrame:
    """``term, key, tf, length``: one row per term and document; terms are stemmed if asked for."""
    words = docs.select(F.col(key), analyse(F.col(text)).alias("w"))
    rows = words.select(key, F.size("w").alias("length"), F.explode("w").alias("term"))
    counted = rows.groupBy("term", key, "length").agg(F.count("*").alias("tf"))
    return stemmed(counted).groupBy("term", key, "length").agg(F.sum("tf").alias("tf")) if stem else counted


def stemmed(rows: DataFrame, term: str = "term") -> DataFrame:
    """Rows with their term replaced by its stem. A term is stemmed once, however often it stands."""
    return rows.join(stems(rows, term, "_stem"), term).withColumn(term, F.col("_stem")).drop("_stem")


#: Rows of a query side that are sent to every executor; more are shuffled.
MOST_SENT = 200_000


def is_small(df: DataFrame, most: int = MOST_SENT) -> bool:
    return df.limit(most + 1).count() <= most


def sent_if_small(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """``df``, marked for broadcast if it has no more than ``most`` rows."""
    return F.broadcast(df) if is_small(df, most) else df


def bm25(posted: DataFrame, key: str, query_terms: DataFrame, n_docs: int, mean_length: float) -> DataFrame:
    """``query_id, key, score, matched``: relevance of each document that holds a query term (``query_id, term``)."""
    variants = query_terms.select("query_id", "term").distinct().withColumns({"variant": F.col("term"), "factor": F.lit(1.0)})
    return bm25_of_variants(posted, key, variants, n_docs, mean_length, one_each=True)


def bm25_of_variants(posted: DataFrame, key: str, variants: DataFrame, n_docs: int, mean_length: float, one_each: bool = False) -> DataFrame:
    """``query_id, key, score, matched`` for query terms that stand in the postings as ``variant`` (``query_id, term, variant,
    factor``): a term counts with its best variant in a document.

    Document frequencies are counted before anything moves. A small query side is sent to the postings: those that it asks for
    are shuffled by document, once, and a document's scores are summed where its postings are, so that of the pairs of
    queries and documents none is shuffled for its sum.
    """
    asked = sent_if_small(variants.select(F.col("variant").alias("term")).distinct())
    held = posted.join(asked, "term", "left_semi")
    frequency = held.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    found = variants.join(frequency.withColumnRenamed("term", "variant"), "variant")
    weighted = found.select("query_id", F.col("term").alias("_of"), F.col("variant").alias("term"), (idf * F.col("factor")).alias("_idf"))
    if is_small(weighted):
        weighted, held = F.broadcast(weighted), held.repartition(key)
    gain = F.col("_idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(float(mean_length))))
    scored = held.join(weighted, "term").withColumn("w", gain)
    if not one_each:
        scored = scored.groupBy("query_id", key, "_of").agg(F.max("w").alias("w"))
    return scored.groupBy("query_id", key).agg(F.sum("w").alias("score"), F.count("*").alias("matched"))


def match_all(scored: DataFrame, query_terms: DataFrame) -> DataFrame:
    """Hits that hold every term of their query."""
    need = query_terms.distinct().groupBy("query_id").agg(F.count("*").alias("need"))
    return scored.join(need, "query_id").where(F.col("matched") == F.col("need")).drop("need")


def best_fields(scores: list[Column], boosts: list[float], tie: float = 0.3) -> Column:
    """The best boosted field score and a share of the others."""
    boosted = [F.coalesce(s, F.lit(0.0)) * b for s, b in zip(scores, boosts, strict=True)]
    best = F.greatest(*boosted) if len(boosted) > 1 else boosted[0]
    return best + (reduce(lambda a, b: a + b, boosted) - best) * tie


def relative_cutoff(hits: DataFrame, share: float = 0.6, by: str = "query_id", score: str = "score") -> DataFrame:
    """Hits that reach a share of their query's best score; 0 keeps all. The best scores, a row for each query of a stated set,
    are sent to the hits: these are neither shuffled nor sorted by query."""
    if share <= 0:
        return hits
    top = F.broadcast(hits.groupBy(F.col(by).alias("_by")).agg(F.max(score).alias("_top")))
    return hits.join(top, F.col(by).eqNullSafe(F.col("_by"))).where(F.col(score) >= share * F.col("_top")).drop("_by", "_top")


def ranked(hits: DataFrame, by: str, key: str, score: str = "score") -> DataFrame:
    """All hits of each query with their ``rank``; ties by key."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), key)))


def top_hits(hits: DataFrame, n: int, by: str, key: str, score: str = "score") -> DataFrame:
    """The best ``n`` hits of each query with their ``rank``; ties by key."""
    return ranked(hits, by, key, score).where(F.col("rank") <= n)


def fuzzy_terms(vocabulary: DataFrame, query_terms: DataFrame) -> DataFrame:
    """``query_id, term, variant, edits``: vocabulary terms within the edits that a term's length allows (none up
    to 2 letters, 1 up to 5, else 2).

    Candidates share a deletion form with the term: every word within two edits does, so no pair of the two
    sides is compared that does not.
    """
    allowed = lambda c: F.when(F.length(c) <= 2, 0).when(F.length(c) <= 5, 1).otherwise(2)

    def one_less(words: Column) -> Column:
        shorter = lambda w: F.when(F.length(w) > 1, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1, F.length(w))))).otherwise(F.array(F.lit("")))
        return F.array_distinct(F.concat(words, F.flatten(F.transform(words, shorter))))

    forms = lambda c: one_less(one_less(F.array(c)))
    left = query_terms.select("query_id", "term", F.explode(forms(F.col("term"))).alias("form"))
    right = vocabulary.select(F.col("term").alias("variant"), F.explode(forms(F.col("term"))).alias("form"))
    pairs = left.join(right, "form").select("query_id", "term", "variant").distinct()
    return pairs.withColumn("edits", F.levenshtein("term", "variant")).where(F.col("edits") <= allowed(F.col("term")))
