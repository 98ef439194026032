"""Quality rules by weak supervision.

Each rule votes for (1), against (-1) or abstains (0). Documents are counted by vote pattern, at most 3 to the number
of rules of them, and expectation-maximisation runs over these counts inside one row: it estimates each rule's
accuracy and the share of good documents without labels. The posterior of a pattern replaces an all-must-pass rule.
Everything is a DataFrame or SQL expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, text_of, written

#: Frequent function words of the corpus languages.
FUNCTION_WORDS = ["the", "of", "and", "to", "in", "is", "that", "for", "with", "der", "die", "das", "und", "ein", "eine", "mit", "von", "le", "la", "les", "de", "des", "et", "un", "une", "que", "el", "los", "las", "y", "en", "del", "se"]
ITERATIONS = 25

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_caps", "n_marks", "n_function", "n_stops"]


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.transform(F.array(value), body)[0]


def measures(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with the counts that rules look at, each of the whole text (null: empty)."""
    text = text_of(docs, text_column)
    base = docs.withColumn("_text", text).withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    words = F.col("_words")
    n = F.size(words)
    lines = F.filter(F.split(F.col("_text"), "\n", -1), lambda x: x.rlike(WORD))
    triples = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(1))), lambda x, i: F.xxhash64(x, words[i + 1], words[i + 2])))
    step = base.withColumns({"_lines": lines, "_triples": triples})

    def again(s: Column) -> Column:
        """Positions, in order, of the triples that stand next to an equal one when sorted."""
        return F.sort_array(F.transform(F.filter(s, lambda e, i: ((i > 0) & (F.get(s, i - 1)["h"] == e["h"])) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False))), lambda e: e["i"]))

    def covered(p: Column) -> Column:
        """Words under three-word windows at these positions."""
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    paired = F.sort_array(F.transform(F.col("_triples"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.when(F.size(F.array_distinct("_triples")) == F.size("_triples"), F.lit(0)).otherwise(_let(_let(paired, again), covered))
    squeezed = F.regexp_replace(F.col("_text"), r"[\x20\x09-\x0D]+", "")
    stops = F.array(*[F.lit(w) for w in FUNCTION_WORDS])
    return step.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(squeezed).cast("long"),
        "n_symbols": F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeats.cast("long"),
        "n_caps": F.regexp_count("_text", F.lit(r"\p{Lu}{2,}")).cast("long"),
        "n_marks": (F.length("_text") - F.length(F.replace("_text", F.lit("!"), F.lit("")))).cast("long"),
        "n_function": F.size(F.filter(words, lambda w: F.array_contains(stops, F.lower(w)))).cast("long"),
        "n_stops": F.regexp_count("_text", F.lit(r"[.;:?](?=[\x20\x09-\x0D]|$)")).cast("long"),
    }).drop("_text", "_words", "_lines", "_triples")


def votes() -> dict[str, tuple[str, str]]:
    """Rule: the SQL conditions under which it votes for and against; otherwise it abstains.

    A fault is no vote for the document where it is absent, so most rules vote against or abstain.
    """
    return {
        "symbols": ("false", "100 * n_symbols >= 10 * n_words"),
        "capitals": ("false", "100 * n_caps >= 40 * n_words"),
        "exclamations": ("false", "100 * n_marks >= 30 * n_words"),
        "repeated_lines": ("false", "n_dup_lines > 2 and 100 * n_dup_lines >= 30 * n_lines"),
        "repeated_words": ("false", "100 * n_repeat_words >= 40 * n_words"),
        "word_length": ("false", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
        "function_words": ("100 * n_function >= 6 * n_words", "100 * n_function <= 4 * n_words"),
        "sentences": ("100 * n_stops between 7 * n_words and 25 * n_words", "n_stops = 0 and n_words >= 60"),
    }


#: EM starts from these; accuracies stay within the bounds, so that a rule never counts as worse than chance.
START_ACCURACY, START_SHARE, LEAST, MOST = 0.8, 0.8, 0.55, 0.99

#: Log odds of a good document given the votes v: the prior's, and each vote times its rule's log odds of being right.
SCORE = "({0}.b + aggregate(zip_with({1}.v, {0}.w, (v, w) -> v * w), 0D, (a, x) -> a + x))"


def em_sql(n_rules: int, iterations: int = ITERATIONS) -> str:
    """SQL over one row with ``_p``, an array of struct(v array<int>, c double): the fitted struct(w array<double>, b double)."""
    tally = "aggregate(zip_with(_p, q, (p, g) -> {0}), 0D, (a, x) -> a + x)"
    right = tally.format("p.c * CASE p.v[j] WHEN 1 THEN g WHEN -1 THEN 1 - g ELSE 0D END")
    voted = tally.format("p.c * CAST(abs(p.v[j]) AS DOUBLE)")
    share = f"({tally.format('p.c * g')} + 1) / ({tally.format('p.c')} + 2)"
    odds = "ln({0} / (1 - {0}))"
    new_w = f"transform(sequence(0, {n_rules - 1}), j -> transform(array(least({MOST}D, greatest({LEAST}D, ({right} + 8) / ({voted} + 10)))), a -> {odds.format('a')})[0])"
    new_b = f"transform(array(least(0.98D, greatest(0.5D, {share}))), a -> {odds.format('a')})[0]"
    start = f"named_struct('w', array_repeat({odds.format(f'{START_ACCURACY}D')}, {n_rules}), 'b', {odds.format(f'{START_SHARE}D')})"
    q = f"transform(_p, p -> 1 / (1 + exp(-{SCORE.format('s', 'p')})))"
    return f"aggregate(sequence(1, {iterations}), {start}, (s, i) -> transform(array({q}), q -> named_struct('w', {new_w}, 'b', {new_b}))[0])"


def posteriors(counts: DataFrame, n_rules: int) -> DataFrame:
    """From ``counts`` (_votes array<int>, _n): _votes, _good. At most 3 ** n_rules rows."""
    row = counts.agg(F.sort_array(F.collect_list(F.struct(F.col("_votes").alias("v"), F.col("_n").cast("double").alias("c")))).alias("_p"))
    fitted = row.withColumn("_fit", F.expr(em_sql(n_rules)))
    each = fitted.select("_fit", F.explode("_p").alias("p"))
    return each.select(F.col("p.v").alias("_votes"), F.expr(f"1 / (1 + exp(-{SCORE.format('_fit', 'p')}))").alias("_good"))


def quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """Id, the measures, base_failed, _good (posterior) and kept, one row per document.

    Base: under 50 words, or more than half the words in repeated windows, fails.

    - Null and empty texts have 0 words and so fail; null ids are ids.
    - Texts of any length are measured whole.
    - Rows are judged each for itself, so repeated rows agree; a posterior equal to the threshold is kept.
    - An empty table gives no rows. Of other columns, those of ``carry`` are returned; the rest may have any names.
    """
    named = votes()
    vote = F.array(*[F.expr(f"CASE WHEN {yes} THEN 1 WHEN {no} THEN -1 ELSE 0 END") for yes, no in named.values()])
    kept_columns = [docs[id_column]] + [docs[c] for c in carry or []]
    slim = docs.select(*kept_columns, docs[text_column].alias("_in"))
    judged = measures(slim, "_in").drop("_in").withColumn("_votes", vote)
    judged = written(judged, "quality")
    counts = judged.groupBy("_votes").agg(F.count(F.lit(1)).alias("_n"))
    # Bounded: at most 3 ** 8 patterns.
    table = F.broadcast(posteriors(counts, len(named)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = judged.join(table, "_votes").withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("_good") >= threshold)).drop("_votes")
