"""Classification, routing and ranking by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The policy's providers, their fallbacks and relative costs.
PROVIDERS = {"handwriting": "olmocr", "table": "paddleocr", "formula": "paddleocr", "layout": "mineru", "ordinary": "paddleocr"}
FALLBACKS = {"ordinary": ["olmocr", "mineru"], "layout": ["paddleocr", "olmocr"], "handwriting": ["paddleocr", "mineru"], "table": ["mineru", "olmocr"], "formula": ["mineru", "olmocr"]}
COSTS = {"native_pdf": 0.1, "paddleocr": 1.0, "mineru": 2.0, "olmocr": 3.0, "preserve_source": 0.0}


# What invoices, statements and papers say, and the shares and pages that tell the other classes.
INVOICE = r"\b(invoice|invoice number|amount due|bill to)\b"
STATEMENT = r"\b(balance sheet|cash flows?|income statement|total assets)\b"
PAPER = r"\b(abstract|methodology|references|doi:)\b"


def archetype(text: Column, table_ratio: Column, image_ratio: Column, pages: Column, elements: Column) -> Column:
    """The first class whose rule fits a document."""
    low = F.lower(text)
    boxes = sum((F.contains(text, F.lit(x)).cast("int") for x in ("☐", "☑", "____")), F.lit(0))
    return (
        F.when(low.rlike(INVOICE), "invoice")
        .when(low.rlike(STATEMENT), "financial-statement")
        .when(table_ratio >= 0.35, "spreadsheet")
        .when(low.rlike(PAPER), "academic-paper")
        .when(boxes >= 2, "form")
        .when((image_ratio >= 0.35) & (pages <= 4), "brochure")
        .when((pages <= 3) & (image_ratio >= 0.18), "presentation")
        .when(pages >= 20, "book")
        .when(elements > 0, "report")
        .otherwise("mixed")
    )


def route(elements: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Tasks for elements (kind, confidence, existing, readings, handwritten, complex_layout) that need another look:
    low confidence, disagreement (more than one distinct reading), tables, formulas and handwriting. Adds content,
    primary, fallbacks, action and cost; a doubted element that its own provider would read again goes to the next
    fallback, and doubt asks for a consensus of three."""
    low = F.coalesce(F.col("confidence") < threshold, F.lit(False))
    split = F.size(F.array_distinct(F.transform("readings", lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))))) > 1
    hand = F.coalesce("handwritten", F.lit(False))
    content = F.when(hand, "handwriting").when(F.col("kind") == "table", "table").when(F.col("kind") == "formula", "formula").when(F.coalesce("complex_layout", F.lit(False)), "layout").otherwise("ordinary")
    rows = elements.where(~F.col("kind").isin("chart", "image", "figure")).withColumns({"low": low, "split": split, "content": content})
    rows = rows.where(F.col("low") | F.col("split") | F.col("content").isin("handwriting", "table", "formula"))
    table = F.create_map(*[x for k, v in PROVIDERS.items() for x in (F.lit(k), F.array(F.lit(v), *map(F.lit, FALLBACKS[k])))])
    rows = rows.withColumn("_line", table[F.col("content")])
    doubt = F.col("low") | F.col("split")
    turned = F.concat(F.slice("_line", 2, 2), F.slice("_line", 1, 1))
    rows = rows.withColumn("_line", F.when(doubt & (F.col("existing") == F.col("_line")[0]), turned).otherwise(F.col("_line")))
    costs = F.create_map(*[x for k, v in COSTS.items() for x in (F.lit(k), F.lit(v))])
    used = F.when(doubt, F.col("_line")).otherwise(F.slice("_line", 1, 1))
    action = F.when(F.col("split"), "adjudicate").when(F.col("low"), "retry").otherwise("extract")
    cost = F.aggregate(F.transform(used, lambda p: F.coalesce(costs[p], F.lit(1.0))), F.lit(0.0), lambda a, x: a + x)
    return rows.withColumns({"primary": F.col("_line")[0], "fallbacks": F.slice("_line", 2, 2), "action": action, "cost": cost}).drop("_line")


def plan_totals(tasks: DataFrame, keys: list[str], available: list[str]) -> DataFrame:
    """Of the tasks of a plan their number, their cost together, and the distinct primary providers that are not there."""
    gone = F.when(~F.col("primary").isin(*available), F.col("primary"))
    return tasks.groupBy(*keys).agg(F.count(F.lit(1)).alias("tasks"), F.sum("cost").alias("cost"), F.array_sort(F.collect_set(gone)).alias("unavailable"))


def rank_providers(requests: DataFrame, providers: DataFrame, features: list[str]) -> DataFrame:
    """Rank providers (provider, privacy, cost, needs_credentials, modes and boolean features) for requests (request, mode and
    needed features). Score: 1000, 20 for each match, 30 for the mode, 4 a step of privacy, up to 4 for low cost, 2
    without credentials; what lacks something has minus the number it lacks. Compatible ones come first, then by
    score and name. Every provider is ranked for every request, as that is the result. The providers' table is a small
    dimension: up to 1,000 are broadcast; more are dealt out by name, and each request goes to every part."""
    small = providers.limit(1001).count() <= 1000
    right = providers.select("provider", "privacy", F.col("cost").alias("_cost"), "needs_credentials", "modes", *[F.col(f).alias(f"has_{f}") for f in features])
    if small:
        met = requests.crossJoin(F.broadcast(right))
    else:
        parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        each = requests.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        met = each.join(right.withColumn("_part", F.pmod(F.xxhash64("provider"), F.lit(parts)).cast("int")), "_part").drop("_part")
    wants = [(F.col(f), F.col(f"has_{f}")) for f in features] + [(F.col("mode").isNotNull(), F.array_contains("modes", F.col("mode")))]
    matched = sum((F.when(w & h, 1).otherwise(0) for w, h in wants), F.lit(0))
    missing = sum((F.when(w & ~h, 1).otherwise(0) for w, h in wants), F.lit(0))
    rows = met.withColumns({"matched": matched, "missing": missing})
    score = 1000 + 20 * F.col("matched") + F.when(F.col("mode").isNotNull(), 30).otherwise(0) + 4 * F.col("privacy") + F.greatest(F.lit(0), 4 - F.col("_cost")) + F.when(F.col("needs_credentials"), 0).otherwise(2)
    rows = rows.withColumn("score", F.when(F.col("missing") == 0, score).otherwise(-F.col("missing")))
    order = Window.partitionBy("request").orderBy((F.col("missing") > 0), F.col("score").desc(), "provider")
    return rows.withColumn("rank", F.row_number().over(order)).select("request", "rank", "provider", (F.col("missing") == 0).alias("compatible"), "score", "matched", "missing")


def top_traces(traces: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The ``n`` best distinct candidates of a key: by total, text, geometry and type score, then page and id."""
    order = [F.col(c).desc() for c in ("total", "text_score", "geometry_score", "type_score")] + [F.col("page"), F.col("candidate_id")]
    first = Window.partitionBy(*keys, "candidate_id").orderBy(*order)
    rows = traces.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def first_success(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Of attempts (rank, provider, ok) the first that succeeded, else null, and how many were made until then."""
    return attempts.groupBy(*keys).agg(F.min_by("provider", F.when(F.col("ok"), F.col("rank"))).alias("provider"), F.coalesce(F.min(F.when(F.col("ok"), F.col("rank"))), F.count(F.lit(1))).alias("tries"))
