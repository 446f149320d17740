"""Keyword matching between questions and named things (tables, columns, definitions).

Questions and names are cut into tokens once and joined on the token; scores are
sums over what meets. Names that must occur literally are found through their
first letters and then verified. The catalog side is broadcast only after its
size was checked; otherwise the joins shuffle on the token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.session import lookup_join

# Synonym groups, terms that keep their form, and the score parts.
SYNONYMS = {
    "revenue": ["sales", "income", "gross", "paid", "amount", "payment", "order"],
    "customer": ["client", "buyer", "account", "user"],
    "user": ["member", "account", "profile"],
    "order": ["purchase", "transaction", "sale"],
    "product": ["item", "sku", "goods"],
    "date": ["time", "created", "timestamp", "month", "week", "year"],
    "churn": ["cancellation", "inactive", "lost", "stopped"],
    "subscription": ["plan", "membership"],
}
KEPT_TERMS = ["mrr", "arr", "ltv", "gmv", "cac", "kpi", "id"]
EXACT_TABLE, TABLE_TOKEN, COLUMN_HIT, TYPE_HIT, SYNONYM_HIT, IMPORTANCE_WEIGHT, INTERNAL_PENALTY = 3.0, 1.5, 1.0, 0.5, 1.0, 0.5, 2.0
TOP_TABLES = 8


def singular(token: Column) -> Column:
    n = F.length(token)
    return (
        F.when(token.isin(KEPT_TERMS), F.lit(None))
        .when(token.endswith("ies") & (n > 4), F.concat(F.substring(token, F.lit(1), n - 3), F.lit("y")))
        .when(token.endswith("es") & (n > 3), F.substring(token, F.lit(1), n - 2))
        .when(token.endswith("s") & (n > 3) & ~token.endswith("ss"), F.substring(token, F.lit(1), n - 1))
    )


def tokens(text: Column) -> Column:
    """Lower-case words and their singular forms, without repeats."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.array_compact(F.concat(words, F.transform(words, singular))))


def groups_of(words: Column) -> Column:
    """Heads of the synonym groups that a token list touches."""
    table = F.create_map(*[F.lit(x) for w, heads in _group_index().items() for x in (w, F.array(*[F.lit(h) for h in heads]))])
    found = F.flatten(F.array_compact(F.transform(words, lambda w: F.try_element_at(table, w))))
    return F.array_distinct(found)


def _group_index() -> dict[str, list[str]]:
    index: dict[str, list[str]] = {}
    for head, others in SYNONYMS.items():
        for word in [head, *others]:
            index.setdefault(word, []).append(head)
    return index


def expanded(words: Column) -> Column:
    """Tokens plus every synonym group one of them belongs to."""
    members = F.create_map(*[F.lit(x) for h, o in SYNONYMS.items() for x in (h, F.array(*[F.lit(w) for w in [h, *o]]))])
    return F.array_distinct(F.concat(words, F.flatten(F.transform(groups_of(words), lambda h: members[h]))))


# Letters by which literal names are looked up.
LEAD = 3


def holding(questions: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """Pairs of rows where the text ``q`` holds the non-empty name: joined on the name's first letters, then verified."""
    col_of = F.col(name)
    lead = F.substring(col_of, 1, LEAD)
    listed = names.filter(col_of != "").withColumn("_lead", lead)
    widths = sorted(r[0] for r in listed.select(F.length("_lead")).distinct().collect())

    def cut(width: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("q") - (width - 1)))
        return F.transform(places, lambda i: F.substr("q", i, F.lit(width)))

    cuts = [cut(w) for w in widths]
    if not cuts:
        return questions.crossJoin(listed.limit(0)).drop("_lead")
    leads = questions.withColumn("_lead", F.explode(F.array_distinct(F.concat(*cuts))))
    return lookup_join(leads, listed, "_lead", "inner").filter(F.contains(F.col("q"), col_of)).drop("_lead")


def catalog_terms(annotated: DataFrame, ranked: DataFrame) -> DataFrame:
    """``(table, importance, is_internal, token, slot, ordinal, column, weight)``: the tokens of the catalog and what each is worth.

    A slot counts once per question, whichever of its tokens meet: a word of the table's name, a column, a column's meaning, or a synonym group.
    """
    ranked = ranked.select("table", "importance", "is_internal")
    words = tokens(F.regexp_replace("table", r"^.*\.", ""))
    none, plain = F.lit(None).cast("int"), F.lit(None).cast("string")
    named = ranked.select("*", F.explode(words).alias("token")).select(
        "*", F.concat(F.lit("word "), "token").alias("slot"), none.alias("ordinal"), plain.alias("column"), F.lit(TABLE_TOKEN).alias("weight"))
    grouped = ranked.select("*", F.explode(groups_of(words)).alias("head")).select(
        *ranked.columns, F.concat(F.lit("group "), "head").alias("token"), F.concat(F.lit("group "), "head").alias("slot"),
        none.alias("ordinal"), plain.alias("column"), F.lit(SYNONYM_HIT).alias("weight"))
    columns = annotated.select("table", "ordinal", "column", "semantic_type").join(ranked, "table")
    held = columns.select("*", F.explode(tokens(F.col("column"))).alias("token")).select(
        *ranked.columns, "token", F.concat(F.lit("column "), F.col("ordinal").cast("string")).alias("slot"), "ordinal", "column",
        F.lit(COLUMN_HIT).alias("weight"))
    meant = columns.filter(F.col("semantic_type") != "unknown").select(
        *ranked.columns, F.col("semantic_type").alias("token"), F.concat(F.lit("type "), F.col("ordinal").cast("string")).alias("slot"),
        none.alias("ordinal"), plain.alias("column"), F.lit(TYPE_HIT).alias("weight"))
    whole = ranked.select(
        "*", plain.alias("token"), F.lit("name").alias("slot"), none.alias("ordinal"), plain.alias("column"), F.lit(EXACT_TABLE).alias("weight"))
    return named.unionByName(grouped).unionByName(held).unionByName(meant).unionByName(whole)


def search_schema(questions: DataFrame, catalog: DataFrame, k: int = TOP_TABLES) -> DataFrame:
    """``(question_id, rank, table, score, columns)``: the best tables per question, from the index of ``catalog_terms``."""
    terms = expanded(tokens(F.col("text")))
    heads = F.transform(groups_of(terms), lambda h: F.concat(F.lit("group "), h))
    asked = questions.select("question_id", F.explode(F.array_distinct(F.concat(terms, heads))).alias("token"))
    met = lookup_join(asked, catalog.filter("token IS NOT NULL"), "token", "inner").drop("token")
    spoken = holding(questions.select("question_id", F.lower("text").alias("q")),
                     catalog.filter("slot = 'name'").drop("token").withColumn("name", F.lower("table"))).drop("q", "name")
    slots = F.collect_set(F.struct("ordinal", "slot", "column", "weight"))
    pairs = met.unionByName(spoken).groupBy("question_id", "table", "importance", "is_internal").agg(F.sort_array(slots).alias("slots"))
    lexical = F.aggregate("slots", F.lit(0.0), lambda acc, s: acc + s["weight"])
    columns = F.slice(F.transform(F.filter("slots", lambda s: s["column"].isNotNull()), lambda s: s["column"]), 1, 5)
    penalty = F.when(F.col("is_internal"), INTERNAL_PENALTY).otherwise(0.0)
    score = F.round(lexical + IMPORTANCE_WEIGHT * F.col("importance") - penalty, 2)
    scored = pairs.select("question_id", "table", score.alias("score"), columns.alias("columns")).filter(F.col("score") > 0)
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "table")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _words_only(text: Column) -> Column:
    """Text between blanks, with everything but letters, digits and underscores as blanks."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9_]+", " "), F.lit(" "))


def ground(questions: DataFrame, names: DataFrame) -> DataFrame:
    """``(question_id, name, how)``: names that occur as a whole phrase or share a token."""
    phrase = _words_only(F.col("name"))
    first = F.regexp_extract(phrase, "[a-z0-9_]+", 0)
    asked = questions.select("question_id", _words_only(F.col("text")).alias("q"), tokens(F.col("text")).alias("terms"))
    # A phrase can only occur where its first word does.
    words = asked.select("question_id", "q", F.explode(F.array_distinct(F.regexp_extract_all("q", F.lit("[a-z0-9_]+"), F.lit(0)))).alias("word"))
    known = names.select("name", phrase.alias("phrase"), first.alias("word"))
    whole = lookup_join(words, known, "word", "inner").filter(F.contains(F.col("q"), F.col("phrase"))).select("question_id", "name", F.lit("phrase").alias("how"))
    held = names.select("name", F.explode(tokens(F.col("name"))).alias("word"))
    shared = lookup_join(asked.select("question_id", F.explode("terms").alias("word")), held, "word", "inner").select("question_id", "name", F.lit("token").alias("how"))
    # "phrase" sorts before "token": the stronger tie is kept.
    return whole.unionByName(shared).groupBy("question_id", "name").agg(F.min("how").alias("how"))


def match_definitions(questions: DataFrame, definitions: DataFrame) -> DataFrame:
    """``(question_id, kind, key, score, size)`` for definitions that relate to a question.

    ``definitions`` has ``kind, key, phrases, physical, description, size``: a
    phrase in the question scores 100, else ten per token shared with the
    description; a physical table or column name lifts the score to 80.
    """
    own = ["kind", "key", "size"]
    asked = questions.select("question_id", F.lower("text").alias("q"))
    said = holding(asked, definitions.select(*own, F.explode(F.transform("phrases", F.lower)).alias("name")))
    bound = definitions.filter(F.col("kind").isin("table", "column"))
    shown = holding(asked, bound.select(*own, F.explode(F.transform("physical", F.lower)).alias("name")))
    held = definitions.select(*own, F.explode(tokens(F.col("description"))).alias("word"))
    shared = lookup_join(questions.select("question_id", F.explode(tokens(F.col("text"))).alias("word")), held, "word", "inner")
    kinds = [
        said.select("question_id", *own, F.lit(100).alias("least"), F.lit(0).alias("more")),
        shown.select("question_id", *own, F.lit(80).alias("least"), F.lit(0).alias("more")),
        shared.select("question_id", *own, F.lit(0).alias("least"), F.lit(10).alias("more")),
    ]
    score = F.greatest(F.max("least"), F.when(F.max("least") < 100, F.sum("more")).otherwise(0))
    hits = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).groupBy("question_id", *own).agg(score.cast("long").alias("score"))
    return hits.select("question_id", "kind", "key", "score", "size")


def within_budget(matches: DataFrame, definitions: int = 20, characters: int = 12_000) -> DataFrame:
    """The best definitions per question that fit both budgets; one that is too long is
    passed over and the next one tried. A question has at most as many matches as
    the catalog has definitions."""
    entry = F.struct((-F.col("score")).alias("minus"), "kind", "key", "score", "size")
    listed = matches.groupBy("question_id").agg(F.sort_array(F.collect_list(entry)).alias("found"))
    element = listed.schema["found"].dataType.simpleString()
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("used"), F.expr(f"cast(array() as {element})").alias("kept"))

    def take(acc, m):
        fits = (acc["n"] < definitions) & (acc["used"] + m["size"] <= characters)
        more = F.struct((acc["n"] + 1).alias("n"), (acc["used"] + m["size"]).cast("long").alias("used"), F.concat(acc["kept"], F.array(m)).alias("kept"))
        return F.when(fits, more).otherwise(acc)

    kept = listed.select("question_id", F.aggregate("found", start, take).alias("acc"))
    return kept.select("question_id", F.posexplode("acc.kept").alias("i", "m")).select(
        "question_id", (F.col("i") + 1).alias("rank"), "m.kind", "m.key", "m.score", "m.size"
    )
