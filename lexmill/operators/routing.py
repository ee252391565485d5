"""Intent routing: named rules first, a classifier to arbitrate, a cascade to decide."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from .logistic import accuracies

#: Intents by priority, and the patterns that mark them.
PRIORITY = ("quiz", "practice", "research", "resources", "doubt", "question")
STRONG: dict[str, list[tuple[str, str]]] = {
    "quiz": [
        ("quiz", r"\bquiz(zes|zed)?\b"),
        ("test_me", r"\b(test|examine|assess|evaluate|grade) (me|my (knowledge|understanding|learning))\b"),
        ("mcq", r"\b(mcqs?|multiple[- ]choice)\b"),
        ("question_me", r"\b(question|drill|challenge|ask) me\b"),
        ("flashcards", r"\bflash ?cards?\b"),
        ("self_test", r"\bself[- ]?test\b"),
    ],
    "practice": [
        ("practice_questions", r"\bpractice (questions?|problems?|exercises?|sets?|papers?|tests?|worksheets?)\b"),
        ("sample_questions", r"\b(sample|mock|model|past[- ]paper|exam[- ]style) (questions?|papers?|tests?)\b"),
        ("exercises", r"\b(exercises?|worksheets?|question bank|problem set)\b"),
        ("generate_questions", r"\b(give|generate|create|make|write|prepare|draft|list|produce|frame) (me )?(some |\d+ |a few |more |extra |important )*(short[- ]answer |long[- ]answer |essay |viva |numerical |revision |exam )?(questions?|problems?)\b"),
        ("likely_questions", r"\b(likely|expected|important|possible|probable) (exam )?questions\b"),
        ("what_asked", r"\bwhat (could|can|might|may) (be )?(asked|come)\b"),
    ],
    "research": [
        ("do_research", r"\b(do|run|conduct|perform|start|need|want|more|further|deeper|online|some|quick|background)\s+(more\s+)?research\b"),
        ("research_on", r"\bresearch(ing)?\s+(on|about|into|this|the topic|more|further)\b"),
        ("research_verb", r"^\s*(please\s+)?research\b"),
        ("look_up_online", r"\b(look|search)( it| this| that)? up (online|on the (web|internet))\b"),
        ("search_web", r"\bsearch (the )?(web|internet|online|google|wikipedia)\b"),
        ("latest", r"\b(latest|recent|current|newest) (research|studies|study|developments|news|papers|findings|advances|breakthroughs)\b"),
        ("beyond_doc", r"\b(beyond|outside) (the|this) (document|text|file|notes)\b"),
        ("literature", r"\b(academic|scientific|research) (papers?|literature|articles?)\b"),
    ],
    "resources": [
        ("resources_word", r"\b(study |learning |reading |educational )?(resources?|materials?)\b(?! (in|from|of|on) (the|this) (document|text|file))"),
        ("videos", r"\b(youtube|videos?|playlists?|lectures?|podcasts?|moocs?)\b"),
        ("tutorials_courses", r"\b(tutorials?|courses?|textbooks?|study guides?|cheat ?sheets?|reading list)\b"),
        ("where_study", r"\bwhere (can|do|should|to) (i|we|you)?\s*(study|learn|read|find (more|study|notes|material))\b"),
        ("recommend_books", r"\b(recommend|suggest)\w* (me )?(some |good |the best )?(books?|websites?|channels?|links?|articles?)\b"),
    ],
    "doubt": [
        ("dont_understand", r"\b(i )?(don'?t|do not|dont|didn'?t|did not|can'?t|cannot|couldn'?t|could not|still (don'?t|do not|not))\s+(really\s+)?(understand|get|follow|grasp|see)\b"),
        ("confused", r"\b(confus(ed|ing)|puzzled|baffled)\b"),
        ("make_sense", r"\b(doesn'?t|does not|don'?t|makes? no) (make )?sense\b"),
        ("again_simpler", r"\b(explain|say|put|phrase|rephrase|tell)( it| that| this)?( to me)?\s*(again|simpler|more simply|differently|in simple|in plain|like i'?m)\b"),
        ("simplify", r"\b(simpl(er|ify|ified|e terms|e words)|plain english|layman|eli5|like i'?m (five|5))\b"),
        ("what_mean", r"\bwhat do you mean\b"),
        ("stuck", r"\b(i'?m|i am) (stuck|lost|struggling|having (a )?(hard|difficult|trouble))\b"),
        ("not_clear", r"\b(not|isn'?t|still not) (very )?clear\b"),
        ("go_slower", r"\b(go|walk me through it) slower|over my head|lost me\b"),
    ],
}
#: Signs of a question that decide nothing alone.
WEAK: list[tuple[str, str]] = [
    ("wh_start", r"^\s*(why|how|what|when|where|who|which|whose|is|are|does|do|can|could|did)\b"),
    ("explain", r"\bexplain\b"),
    ("why", r"\bwhy\b"),
    ("define", r"\b(define|definition of|difference between|meaning of)\b"),
    ("question_mark", r"\?\s*$"),
]


def _hits(text: Column, rules: list[tuple[str, str]], prefix: str) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike("(?i)" + rx), F.lit(f"{prefix}:{name}")) for name, rx in rules]))


def strong_hits(text: Column) -> Column:
    """Names of all matching strong rules, intent by intent."""
    return F.concat(*[_hits(text, rules, intent) for intent, rules in STRONG.items()])


def weak_hits(text: Column) -> Column:
    return _hits(text, WEAK, "question")


def route(messages: DataFrame, text: str = "query", probs: str | None = None, s: Settings = SETTINGS) -> DataFrame:
    """``messages`` with intent, confidence, method and matched_rules.

    ``probs`` names a map<string, double> of classifier probabilities; without it, or where it
    is null, ties of rules go by priority and no rule at all falls back to a plain question.
    """
    q = F.trim(F.col(text))
    p = F.col(probs) if probs else F.lit(None).cast("map<string,double>")
    base = messages.withColumn("_strong", strong_hits(q)).withColumn("_weak", weak_hits(q))
    base = base.withColumn("_intents", F.array_distinct(F.transform("_strong", lambda r: F.substring_index(r, ":", 1)))).withColumn("_p", p)
    one, several = F.size("_intents") == 1, F.size("_intents") > 1
    entries = F.map_entries("_p")

    def best(of: Column) -> Column:
        """(intent, probability) of the greatest probability; ties go by priority."""
        order = F.array_sort(of, lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(_rank(a["key"]) < _rank(b["key"]), -1).otherwise(1))
        return F.element_at(order, 1)

    among = F.filter(entries, lambda e: F.array_contains("_intents", e["key"]))
    total = F.aggregate(among, F.lit(0.0), lambda a, e: a + e["value"])
    top, pick = best(entries), best(among)
    first = F.element_at(F.filter(F.array(*[F.lit(i) for i in PRIORITY]), lambda i: F.array_contains("_intents", i)), 1)
    sure = F.coalesce(top["value"] >= s.router_min_probability, F.lit(False))
    with_p = F.col("_p").isNotNull()
    weak = F.size("_weak") > 0
    intent = F.when(one, F.element_at("_intents", 1)).when(several & with_p, pick["key"]).when(several, first).when(sure, top["key"]).otherwise("question")
    rule_confidence = F.least(F.lit(0.99), s.router_rule_confidence + 0.02 * (F.size("_strong") - 1))
    arbitrated = pick["value"] / F.when(total == 0, 1.0).otherwise(total)
    confidence = F.when(one, rule_confidence).when(several & with_p, arbitrated).when(several, 0.5).when(sure, top["value"]).when(weak, 0.5).otherwise(F.coalesce(top["value"], F.lit(0.3)))
    method = F.when(one, "rules").when(several & with_p, "classifier").when(several, "rules").when(sure, "classifier").when(weak, "rules").otherwise("fallback")
    return base.select(
        *messages.columns, intent.alias("intent"), F.round(confidence, 4).alias("confidence"), method.alias("method"),
        F.when(F.size("_strong") > 0, F.col("_strong")).otherwise(F.col("_weak")).alias("matched_rules"),
    )


def _rank(intent: Column) -> Column:
    return F.array_position(F.array(*[F.lit(i) for i in PRIORITY]), intent)


def classifier(label: str = "intent", text: str = "query", regularisation: float = 0.01, features: int = (1 << 31) - 1) -> Pipeline:
    """Word uni- and bigrams, log term frequency, inverse document frequency, balanced multinomial
    logistic regression.  The input needs a ``weight`` column (see ``balanced``).  All features count:
    ``features`` only bounds them where a caller asks for it."""
    return Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="label", handleInvalid="keep", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"(?U)[\w']+", gaps=False),
        NGram(n=2, inputCol="_w", outputCol="_b"),
        SQLTransformer(statement="SELECT *, concat(_w, _b) AS _t FROM __THIS__"),
        CountVectorizer(inputCol="_t", outputCol="_c", vocabSize=features),
        IDF(inputCol="_c", outputCol="_f"),
        VectorAssembler(inputCols=["_f"], outputCol="features"),
        LogisticRegression(weightCol="weight", regParam=regularisation, maxIter=15),
    ])


def balanced(rows: DataFrame, label: str = "intent") -> DataFrame:
    """``rows`` with the weight n / (classes * n of the row's class)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    totals = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    weights = counts.crossJoin(F.broadcast(totals)).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return rows.join(weights, label)


def load_labelled(rows: DataFrame, text: str = "query", label: str = "intent", known: tuple[str, ...] = PRIORITY) -> DataFrame:
    """Trimmed labelled rows; empty texts and unknown labels go."""
    clean = rows.select(F.trim(text).alias(text), F.trim(label).alias(label))
    return clean.where((F.col(text) != "") & F.col(label).isin(*known))


def label_integrity(rows: DataFrame, text: str = "query", label: str = "intent", each: int = 40) -> DataFrame:
    """(label, n, duplicates, complete): counts, case-insensitive repeats, and whether n is ``each``."""
    keyed = rows.withColumn("_k", F.lower(F.trim(text)))
    return keyed.groupBy(label).agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("_k")).alias("duplicates")).withColumn("complete", F.col("n") == each)


def stratified_folds(rows: DataFrame, label: str, key: str, folds: int = 5) -> DataFrame:
    """``rows`` with a fold number, each class spread evenly, by a hash of the key."""
    w = Window.partitionBy(label).orderBy(F.xxhash64(F.col(key)), F.col(key))
    return rows.withColumn("fold", (F.row_number().over(w) - 1) % folds)


def cross_validate(rows: DataFrame, label: str, text: str, folds: int = 5) -> DataFrame:
    """(fold, n, accuracy): one model a fold, judged on the fold it hasn't seen."""
    return rows.sparkSession.createDataFrame(accuracies(rows, label, text, folds), "fold int, n bigint, accuracy double")


def probabilities(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with probs: map of label to probability."""
    from pyspark.ml.functions import vector_to_array

    labels = model.stages[0].labels
    out = model.transform(rows.withColumn("weight", F.lit(1.0))).withColumn("_a", vector_to_array("probability"))
    pairs = F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), F.slice("_a", 1, len(labels)))
    return out.select(*rows.columns, pairs.alias("probs"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark, path: str, train) -> PipelineModel:
    """The saved model if its Spark version is this one, else a new one from ``train()``, saved."""
    try:
        meta = spark.read.json(f"{path}/metadata").select("sparkVersion").first()
        if meta and meta[0] == spark.version:
            return PipelineModel.load(path)
    except Exception as missing:  # no model there yet
        if "PATH_NOT_FOUND" not in str(missing) and "does not exist" not in str(missing):
            raise
    model = train()
    save_model(model, path)
    return model
