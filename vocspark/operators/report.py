"""Report operators: rule-fired insights, recommendations, summary line, key
metrics, report sections, per-item report, history comparison.

Every report is a DataFrame of rows built from one-row aggregates and scalar
subqueries; nothing is collected to the driver.  Numbers in messages follow
Python's format rules: `.0f` rounds half to even (bround), `+` always signs,
`.0%` is x*100 then `.0f`, `,` groups thousands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocspark import lexicon as lx
from vocspark.functions import labels as lb
from vocspark.functions import lexical as lex
from vocspark.functions import text as tx
from vocspark.operators import aggregate as ag
from vocspark.operators import enrich as en
from vocspark.operators.rank import urgent_by_confidence
from vocspark.session import materialize

# Format helpers -------------------------------------------------------------


def fmt0(x: Column) -> Column:
    """f'{x:.0f}' for x >= 0."""
    return F.bround(x, 0).cast("long").cast("string")


def fmt_signed0(x: Column) -> Column:
    """f'{x:+.0f}'."""
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("+")),
                    F.abs(F.bround(x, 0)).cast("long").cast("string"))


def fmt_pct0(x: Column) -> Column:
    """f'{x:.0%}'."""
    return F.concat(fmt0(x * F.lit(100.0)), F.lit("%"))


def fmt_int(n: Column) -> Column:
    """f'{n:,}'."""
    return F.format_number(n.cast("long"), 0)


def fmt2(x: Column) -> Column:
    return F.format_string("%.2f", F.bround(x, 2))


# KPI row ----------------------------------------------------------------------

DIMENSIONS = ("channel", "segment")


def batch_facts(df: DataFrame, threshold: float = lx.REVIEW_THRESHOLD) -> DataFrame:
    """Everything the reports count, in one pass: one GROUPING SETS expansion of
    the batch over (), (channel), (segment) and (risk, emotion), as rows (kind,
    grp, emotion, counts, means).  It aggregates map-side and has a row a group."""
    dims = [c for c in DIMENSIONS if c in df.columns]
    pair = [c for c in ("risk", "emotion") if c in df.columns] if "risk" in df.columns else []
    cols = [F.count(F.lit(1)).alias("total"),
            *[F.count_if(F.col("sentiment") == c).alias(n) for n, c in
              (("n_pos", "Positive"), ("n_neu", "Neutral"), ("n_neg", "Negative"))],
            F.avg("confidence").alias("avg_conf"),
            F.count_if(F.col("confidence") < F.lit(threshold)).alias("n_low")]
    if "csat" in df.columns:
        cols.append(F.avg("csat").alias("avg_csat"))
    keys = dims + pair
    if not keys:
        return df.agg(*cols).select(F.lit("all").alias("kind"), F.lit(None).cast("string").alias("grp"),
                                    F.lit(None).cast("string").alias("emotion"), "*")
    sets = [[], *[[d] for d in dims], *([pair] if pair else [])]
    heads = [*dims, *pair[:1]]
    g = df.groupingSets([[F.col(c) for c in x] for x in sets], *keys).agg(
        *cols, *[F.grouping(c).alias(f"_no_{c}") for c in heads])
    kind, grp = F.lit("all"), F.lit(None).cast("string")
    for c in heads:
        kind = F.when(F.col(f"_no_{c}") == 0, c).otherwise(kind)
        grp = F.when(F.col(f"_no_{c}") == 0, F.col(c)).otherwise(grp)
    emotion = F.col("emotion") if "emotion" in pair else F.lit(None).cast("string")
    return g.select(kind.alias("kind"), grp.alias("grp"), emotion.alias("emotion"),
                    "total", "n_pos", "n_neu", "n_neg", "avg_conf", "n_low",
                    *[c for c in ("avg_csat",) if "csat" in df.columns])


def kpis_of(facts: DataFrame) -> DataFrame:
    """One row of KPIs from `batch_facts`: counts, shares, net, the gap of each
    dimension with more than one group, and the High-risk rows with their modal
    emotion (ties: the smallest name)."""
    whole = F.col("kind") == "all"
    net = ag.net_score(F.col("n_pos"), F.col("n_neg"), F.col("total"))
    cols = [F.coalesce(F.max(F.when(whole, F.col(c))), F.lit(0)).alias(c)
            for c in ("total", "n_pos", "n_neu", "n_neg", "n_low")]
    cols += [F.max(F.when(whole, F.col(c))).alias(c) for c in ("avg_conf", "avg_csat") if c in facts.columns]
    high = (F.col("kind") == "risk") & (F.col("grp") == "High")
    cols += [F.coalesce(F.sum(F.when(high, F.col("total"))), F.lit(0)).alias("n_high"),
             F.min(F.when(high & F.col("emotion").isNotNull(),
                          F.struct((-F.col("total")).alias("n"), "emotion"))).alias("_modal")]
    for d in DIMENSIONS:
        own = (F.col("kind") == d) & F.col("grp").isNotNull()
        cols += [F.count_if(own).alias(f"_{d}_groups"),
                 F.min(F.when(own, F.struct(net.alias("net"), "grp"))).alias(f"_{d}_lo"),
                 F.min(F.when(own, F.struct((-net).alias("neg"), "grp"))).alias(f"_{d}_hi")]
    k = facts.agg(*cols)
    gaps = F.array(*[F.when(F.col(f"_{d}_groups") > 1, F.struct(F.lit(d).alias("dimension"), F.struct(
        F.col(f"_{d}_lo.grp").alias("worst"), F.col(f"_{d}_lo.net").alias("worst_net"),
        F.col(f"_{d}_hi.grp").alias("best"), (-F.col(f"_{d}_hi.neg")).alias("best_net")).alias("gap")))
        for d in DIMENSIONS])
    t = F.col("total")
    return k.select("total", "n_pos", "n_neu", "n_neg", "n_low", "n_high", "avg_conf",
                    *[c for c in ("avg_csat",) if c in facts.columns],
                    F.col("_modal.emotion").alias("modal_high"),
                    F.map_from_entries(F.filter(gaps, lambda x: x.isNotNull())).alias("gaps"),
                    ag.share(F.col("n_pos"), t).alias("pct_pos"),
                    ag.share(F.col("n_neu"), t).alias("pct_neu"),
                    ag.share(F.col("n_neg"), t).alias("pct_neg"),
                    ag.net_score(F.col("n_pos"), F.col("n_neg"), t).alias("net"),
                    ag.share(F.col("n_low"), t).alias("low_share"))


def kpi_row(df: DataFrame, threshold: float = lx.REVIEW_THRESHOLD) -> DataFrame:
    return kpis_of(batch_facts(df, threshold))


def kpis_with_words(df: DataFrame, threshold: float = lx.REVIEW_THRESHOLD, n: int = 4,
                    facts: DataFrame | None = None) -> DataFrame:
    """The KPI row and, in `_words`, the top words of each class: what the lines
    of a report are made of.  Two passes over the batch."""
    facts = batch_facts(df, threshold) if facts is None else facts
    return ag.with_scalars(kpis_of(facts), {"_words": words_by_class(df, n)})[0]


def mood(net: Column, labels=("strongly positive", "moderately positive", "mixed",
                              "negative — action needed")) -> Column:
    return (F.when(net >= lx.NET_STRONG, labels[0]).when(net >= lx.NET_LEANS, labels[1])
            .when(net >= lx.NET_SPLIT, labels[2]).otherwise(labels[3]))


def words_by_class(df: DataFrame, n: int, sep: str = ", ") -> Column:
    """Scalar map sentiment -> its top-n content words joined by sep (one job
    for every class; at most classes * n rows reach the final aggregate)."""
    from vocspark.operators.rank import top_words_per_sentiment
    t = top_words_per_sentiment(df, n)
    per = t.groupBy("sentiment").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), sep).alias("w"))
    return per.agg(F.map_from_entries(F.collect_list(F.struct("sentiment", "w")))).scalar()


def _gated(words: Column, sentiment: str, count_col: str, min_items: int) -> Column:
    w = F.coalesce(F.try_element_at(words, F.lit(sentiment)), F.lit(""))
    return F.when(F.col(count_col) >= min_items, w).otherwise(F.lit(""))


# J1 / J2 ------------------------------------------------------------------------

def insights(df: DataFrame, threshold: float = lx.REVIEW_THRESHOLD, k: DataFrame | None = None) -> DataFrame:
    """Rule-fired insight lines: (rule_no, rule, line), only fired rules.  A
    caller with several reports of one batch gives its `kpis_with_words` in `k`."""
    net, neg, neu = F.col("net"), F.col("pct_neg"), F.col("pct_neu")
    k = kpis_with_words(df, threshold) if k is None else k
    words, gaps = F.col("_words"), F.col("gaps")
    neg_words = _gated(words, "Negative", "n_neg", 3)
    pos_words = _gated(words, "Positive", "n_pos", 3)
    s = fmt_signed0(net)
    mood_line = (
        F.when(net >= lx.NET_STRONG, F.concat(
            F.lit("**Overall Sentiment Is Strongly Positive** (Net Sentiment Score "), s,
            F.lit("). Customers in this batch are largely happy — the priority is protecting "
                  "and amplifying what works.")))
        .when(net >= lx.NET_LEANS, F.concat(
            F.lit("**Overall Sentiment Leans Positive** (Net Sentiment Score "), s,
            F.lit("), but the "), fmt0(neg),
            F.lit("% negative slice is large enough to matter — address it before it grows.")))
        .when(net >= lx.NET_SPLIT, F.concat(
            F.lit("**Sentiment Is Split** (Net Sentiment Score "), s,
            F.lit("). Positive and negative voices are roughly balanced — customer experience "
                  "is inconsistent, which usually points to an operational issue affecting only "
                  "part of your customers.")))
        .otherwise(F.concat(
            F.lit("**Overall Sentiment Is Negative** (Net Sentiment Score "), s, F.lit("). "),
            fmt0(neg), F.lit("% of this batch is dissatisfied — treat this as an active "
                             "customer-experience incident."))))
    rules = [
        (1, "mood", F.lit(True), mood_line),
        (2, "complaint_themes", neg_words != "", F.concat(
            F.lit("**Complaint Themes:** negative feedback clusters around *"), neg_words,
            F.lit("* — these words point at the likely root causes to investigate first."))),
        (3, "praised_strengths", pos_words != "", F.concat(
            F.lit("**Praised Strengths:** positive feedback repeatedly mentions *"), pos_words,
            F.lit("* — proven strengths to feature in marketing and protect in any process "
                  "change."))),
        (4, "large_neutral", neu >= lx.NEUTRAL_LARGE_PCT, F.concat(
            F.lit("**Large Neutral Segment** ("), fmt0(neu),
            F.lit("%): neutral items often hide questions and pre-purchase signals — mining "
                  "them is a low-cost revenue opportunity."))),
        (5, "certainty", F.lit(True), F.concat(
            F.lit("**Model Certainty:** average confidence is "), fmt_pct0(F.col("avg_conf")),
            F.lit("; "), fmt0(F.col("low_share")), F.lit("% of items fall below your "),
            fmt_pct0(F.lit(threshold)),
            F.lit(" AI-confidence weighting and should get human review rather than automated "
                  "handling."))),
    ]
    if "risk" in df.columns:
        me = F.coalesce(F.col("modal_high"), F.lit(lx.FALLBACK_HIGH_RISK_EMOTION)) \
            if "emotion" in df.columns else F.lit(lx.FALLBACK_HIGH_RISK_EMOTION)
        rules.append((6, "high_risk", F.col("n_high") > 0, F.concat(
            F.lit("**"), F.col("n_high").cast("string"),
            F.lit(" High-Risk Items Detected** — intensely negative feedback (dominant emotion: "),
            me, F.lit("). These carry the highest churn and public-escalation risk; see the "
                      "Urgent Alert Box."))))
    if "channel" in df.columns:
        g = F.try_element_at(gaps, F.lit("channel"))
        rules.append((7, "channel_gap", g.isNotNull(), F.concat(
            F.lit("**Channel Gap:** sentiment is weakest on **"), g["worst"],
            F.lit("** (Net "), fmt_signed0(g["worst_net"]), F.lit(") and strongest on **"),
            g["best"], F.lit("** (Net "), fmt_signed0(g["best_net"]),
            F.lit(") — channel-specific experience differences are worth investigating."))))
    if "segment" in df.columns:
        g = F.try_element_at(gaps, F.lit("segment"))
        rules.append((8, "segment_watch", g.isNotNull(), F.concat(
            F.lit("**Segment Watch:** the **"), g["worst"],
            F.lit("** segment has the lowest Net Sentiment ("), fmt_signed0(g["worst_net"]),
            F.lit(") — localised issues (logistics, language, expectations) may be at play."))))
    arr = F.array(*[F.struct(F.lit(n).alias("rule_no"), F.lit(r).alias("rule"),
                             c.alias("fired"), line.alias("line")) for n, r, c, line in rules])
    return k.select(F.inline(arr)).where("fired").drop("fired")


def recommendations(df: DataFrame, threshold: float = lx.REVIEW_THRESHOLD, k: DataFrame | None = None) -> DataFrame:
    """Ordered recommendation lines, numbered from 1: (rec_no, line)."""
    k = kpis_with_words(df, threshold) if k is None else k
    neg_words = _gated(F.col("_words"), "Negative", "n_neg", 3)
    pos_words = _gated(F.col("_words"), "Positive", "n_pos", 3)
    first_neg = F.substring_index(neg_words, ", ", 1)
    has_high = (F.col("n_high") > 0) if "risk" in df.columns else F.lit(False)
    rules = [
        (has_high, F.lit("Triage the Urgent Alert Box first — high-risk items are where churn "
                         "and public escalations start; aim for a response within hours, not days.")),
        (F.col("pct_neg") >= lx.NEGATIVE_PRIORITY_PCT,
         F.lit("Open a priority review of the complaint themes above; assign an owner and re-run "
               "this analysis after the fix ships to measure the effect.")),
        (neg_words != "", F.concat(F.lit("Search the History page for '"), first_neg,
                                   F.lit("' to see whether this theme is new or a long-running issue."))),
        (F.lit(True), F.lit("Respond to every negative item within 24 hours — recovery speed is the "
                            "single strongest lever on churn.")),
        (pos_words != "", F.lit("Invite the happiest customers (high-confidence Positive) to leave "
                                "public reviews — social proof compounds.")),
        (F.col("low_share") > lx.LOW_CONFIDENCE_QUEUE_PCT, F.concat(
            F.lit("Set up a human review queue for the "), fmt0(F.col("low_share")),
            F.lit("% low-confidence items before automating actions on this data."))),
        (F.lit(True), F.lit("Track the Net Sentiment Score over time in the History page — the "
                            "trend matters more than any single batch.")),
    ]
    # inline (a generator), not a higher-order function: the lines hold scalar subqueries
    arr = F.array(*[F.struct(F.lit(i).alias("idx"), c.alias("fired"), line.alias("line"))
                    for i, (c, line) in enumerate(rules)])
    fired = k.select(F.inline(arr)).where("fired")
    # at most seven rows in one window partition
    return fired.select(F.row_number().over(Window.orderBy("idx")).alias("rec_no"), "line")


# D4 / J3 -------------------------------------------------------------------------

def history_scalar(history: DataFrame) -> Column:
    """Scalar struct(n, net) of the stored history (one aggregate job)."""
    h = history.agg(F.count(F.lit(1)).alias("n"),
                    F.count_if(F.col("sentiment") == "Positive").alias("p"),
                    F.count_if(F.col("sentiment") == "Negative").alias("q"))
    return h.select(F.struct("n", ag.net_score(F.col("p"), F.col("q"), F.col("n")).alias("net"))
                    .alias("s")).scalar()


def _direction(hs: Column) -> Column:
    """'better than' / 'worse than' / 'in line with' (±5) against the history
    on a KPI row; null unless the history has more rows than the batch."""
    band = lx.HISTORY_DEAD_BAND
    d = F.when(F.col("net") > hs["net"] + band, "better than") \
        .when(F.col("net") < hs["net"] - band, "worse than").otherwise("in line with")
    return F.when(hs["n"] > F.col("total"), d)


def batch_vs_history(batch: DataFrame, history: DataFrame) -> DataFrame:
    """Batch net vs all-time net (only when history has more rows): one row
    with direction 'better than' / 'worse than' / 'in line with' (±5)."""
    k, sc = ag.with_scalars(kpi_row(batch), {"_hs": history_scalar(history)})
    hs = sc["_hs"]
    return k.select(F.col("total").alias("batch_items"), F.col("net").alias("batch_net"),
                                 hs["n"].alias("history_items"), hs["net"].alias("history_net"),
                                 _direction(hs).alias("direction"))


def executive_summary(batch: DataFrame, history: DataFrame | None = None, k: DataFrame | None = None) -> DataFrame:
    """One line: volume, shares, mood, net, confidence, top complaint words
    and the comparison with history (KPI row + one scalar subquery a table).
    Reads no enriched column."""
    k = kpis_with_words(batch, n=3) if k is None else k
    themes = F.substring_index(F.coalesce(F.try_element_at(F.col("_words"), F.lit("Negative")), F.lit("")), ", ", 3)
    if history is not None:
        k, sc = ag.with_scalars(k, {"_hs": history_scalar(history)})
    theme_txt = F.when(themes != "", F.concat(F.lit(" The main complaint themes are "),
                                              themes, F.lit("."))).otherwise(F.lit(""))
    hist_txt = F.lit("")
    if history is not None:
        hs = sc["_hs"]
        d = _direction(hs)
        hist_txt = F.when(d.isNotNull(), F.concat(
            F.lit(" This batch is "), d,
            F.lit(" your overall history (Net Sentiment "), fmt_signed0(F.col("net")),
            F.lit(" vs "), fmt_signed0(hs["net"]), F.lit(" all-time)."))).otherwise(F.lit(""))
    line = F.concat(
        F.lit("Analyzed **"), fmt_int(F.col("total")), F.lit(" feedback items**: **"),
        fmt0(F.col("pct_pos")), F.lit("% Positive**, "), fmt0(F.col("pct_neu")),
        F.lit("% Neutral, **"), fmt0(F.col("pct_neg")), F.lit("% Negative** — overall mood is **"),
        mood(F.col("net")), F.lit("** (Net Sentiment Score "), fmt_signed0(F.col("net")),
        F.lit(", average model confidence "), fmt_pct0(F.col("avg_conf")), F.lit(")."),
        theme_txt, hist_txt)
    return k.select(line.alias("summary"))


# J5 -------------------------------------------------------------------------------

def key_metrics(enriched: DataFrame, threshold: float = lx.REVIEW_THRESHOLD) -> DataFrame:
    """Eight (metric_no, metric, value) rows of the report's key-metrics table."""
    k = kpi_row(enriched, threshold)
    csat = (F.concat(fmt2(F.col("avg_csat")), F.lit(" / 5")) if "csat" in enriched.columns
            else F.lit("n/a"))
    high = F.col("n_high") if "risk" in enriched.columns else F.lit(0)
    rows = [
        ("Total Feedback Volume", F.concat(fmt_int(F.col("total")), F.lit(" items"))),
        ("Positive / Neutral / Negative", F.concat(
            fmt0(F.col("pct_pos")), F.lit("% / "), fmt0(F.col("pct_neu")), F.lit("% / "),
            fmt0(F.col("pct_neg")), F.lit("%"))),
        ("Net Sentiment Score (NSS)", F.concat(fmt_signed0(F.col("net")),
                                               F.lit("  (range -100 to +100)"))),
        ("Average CSAT Equivalent", csat),
        ("Average Model Confidence", fmt_pct0(F.col("avg_conf"))),
        ("AI Confidence Weighting (Review Threshold)", fmt_pct0(F.lit(threshold))),
        ("Items Needing Human Review", fmt_int(F.col("n_low"))),
        ("Urgent (High-Risk) Items", fmt_int(high)),
    ]
    arr = F.array(*[F.struct(F.lit(i + 1).alias("metric_no"), F.lit(m).alias("metric"),
                             v.alias("value")) for i, (m, v) in enumerate(rows)])
    return k.select(F.inline(arr))


# D5 / J6 ----------------------------------------------------------------------

def share_like_this(items: DataFrame, history: DataFrame, id_col: str = "id") -> DataFrame:
    """Per item: % of stored history with the same sentiment, and its size.
    The history side is reduced to one row per class (at most three: it is
    filtered to the class names first), so broadcasting it is size-safe."""
    h = history.where(F.col("sentiment").isin(*lx.CLASSES)) \
        .groupBy("sentiment").agg(F.count(F.lit(1)).alias("_n"))
    j, sc = ag.with_scalars(items.join(F.broadcast(h), "sentiment", "left"),
                            {"_total": history.agg(F.count(F.lit(1))).scalar()})
    total = sc["_total"]
    return j.select(id_col, "sentiment",
                    ag.share(F.coalesce(F.col("_n"), F.lit(0)), total).alias("same_pct"),
                    total.alias("history_items"))


def with_sentence_mix(df: DataFrame, text: str = "text",
                      max_sentences: int | None = None) -> DataFrame:
    """Adds sentences (min 1), positive_sentences, negative_sentences and
    mixed: the rule scorer on each sentence (the first `max_sentences` where
    that is given; documents with fewer than 2 sentences give 0, 0).  Per-row array expressions, no explode
    and no shuffle; the split and the labels are staged so each runs once."""
    d = df.withColumn("_sents", tx.split_sentences(text))
    # clean + lower each sentence once (an inner transform), then score: inside
    # a lambda Spark would otherwise redo the cleaning for every rule word
    kept = F.col("_sents") if max_sentences is None else F.slice("_sents", 1, max_sentences)
    low = F.transform(kept, lambda s: F.lower(tx.clean_text(s, guard=False)))
    d = d.withColumn("_labels", F.transform(low, lb.rule_label_lowered))
    many = F.size("_sents") >= 2

    def count(cls):
        return F.when(many, F.size(F.filter("_labels", lambda x: x == cls))).otherwise(0)

    d = d.withColumns({"sentences": F.greatest(F.size("_sents"), F.lit(1)),
                       "positive_sentences": count("Positive"),
                       "negative_sentences": count("Negative")})
    return d.withColumn("mixed", (F.col("positive_sentences") > 0)
                        & (F.col("negative_sentences") > 0)).drop("_sents", "_labels")


def item_report(enriched: DataFrame, text: str = "text") -> DataFrame:
    """Per item: band, CSAT, emotion, intensity, risk, driver, aspects, text
    statistics, mixed-sentiment flag, meaning and action: projections only.
    Pass `enrich_feedback(df, keep_aspects=True)` to tokenize each text once."""
    if "aspects" not in enriched.columns:
        enriched = en.with_aspects(enriched, text, "aspects")
    d = with_sentence_mix(enriched, text)
    band, _ = lex.confidence_band("confidence")
    d = d.withColumns({
        "band": band,
        "words": tx.word_count(text), "characters": tx.char_count(text),
        "exclamations": tx.exclamation_count(text),
        "meaning": lex.lookup("sentiment", lx.WHAT_IT_MEANS),
        "action": lex.lookup("sentiment", lx.RECOMMENDED_ACTION),
    })
    return d.select("id", "sentiment", "confidence", "band", "csat", "emotion", "intensity",
                    "risk", "driver", F.array_join("aspects", "; ").alias("aspects"), "topic",
                    "words", "characters", "sentences", "exclamations", "positive_sentences",
                    "negative_sentences", "mixed", "meaning", "action")


# J4 ---------------------------------------------------------------------------

def report_sections(enriched: DataFrame, threshold: float = lx.REVIEW_THRESHOLD,
                    history: DataFrame | None = None) -> DataFrame:
    """Markdown report body as (section_no, section, line_no, line): summary,
    insights, recommendations, risk, aspects, groups, urgent items.  A group of
    a dimension is a line, so the report's groups fit in a row."""
    parts = []

    def add(no, name, df_lines: DataFrame):
        parts.append(df_lines.select(F.lit(no).alias("section_no"), F.lit(name).alias("section"),
                                     "line_no", "line"))

    # two small tables, written once: the batch is read for them once each
    facts = materialize(batch_facts(enriched, threshold))
    k = materialize(kpis_with_words(enriched, threshold, facts=facts))
    # no line for a batch without items: it has no shares
    add(0, "summary", executive_summary(enriched, history, k).where("summary IS NOT NULL").select(
        F.lit(1).alias("line_no"), F.replace("summary", F.lit("**"), F.lit("")).alias("line")))
    add(1, "insights", insights(enriched, threshold, k).select(
        F.col("rule_no").alias("line_no"),
        F.concat(F.lit("- "), F.replace(F.col("line"), F.lit("**"), F.lit(""))).alias("line")))
    add(2, "recommendations", recommendations(enriched, threshold, k).select(
        F.col("rec_no").alias("line_no"),
        F.concat(F.col("rec_no").cast("string"), F.lit(". "), F.col("line")).alias("line")))
    if "risk" in enriched.columns:
        risks = facts.where("kind = 'risk'").select(F.col("grp").alias("risk"), F.col("total").alias("items"))
        add(3, "risk_profile", ag.risk_profile(risks, "items").select(
            F.col("rank").alias("line_no"),
            F.concat(F.lit("- "), F.col("risk"), F.lit(": "), F.col("count").cast("string"),
                     F.lit(" items")).alias("line")))
    piv = ag.aspect_pivot(ag.aspect_breakdown(enriched))
    pieces = F.filter(F.array(*[F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(" " + s)))
                                for s in lx.CLASSES]), lambda x: x.isNotNull())
    # the reference lists aspects from a pivot table, i.e. sorted by name (six rows)
    add(4, "aspects", piv.select(
        F.row_number().over(Window.orderBy("aspect")).alias("line_no"),
        F.concat(F.lit("- "), F.col("aspect"), F.lit(": "), F.array_join(pieces, ", ")).alias("line")))
    for no, key in ((5, "channel"), (6, "segment")):
        if key not in enriched.columns:
            continue
        several = k.select(F.map_contains_key("gaps", F.lit(key))).scalar()
        named = F.struct(F.col("grp").alias("key"), F.col("total").alias("items"),
                         ag.net_score(F.col("n_pos"), F.col("n_neg"), F.col("total")).alias("net"))
        g = facts.where((F.col("kind") == key) & F.col("grp").isNotNull()) \
            .agg(F.sort_array(F.collect_list(named)).alias("g")).where(several)
        add(no, f"{key}s", g.select(F.posexplode("g").alias("i", "x")).select(
            (F.col("i") + 1).alias("line_no"),
            F.concat(F.lit("- "), F.col("x.key"), F.lit(": "), F.col("x.items").cast("string"),
                     F.lit(" items, Net Sentiment "), fmt_signed0(F.col("x.net"))).alias("line")))
    urgent = urgent_by_confidence(enriched, 10)
    add(7, "urgent_queue", urgent.select(
        F.row_number().over(Window.orderBy(
            F.desc("confidence"), F.asc("id"))).alias("line_no"),
        F.concat(F.lit("- ("), fmt_pct0(F.col("confidence")), F.lit(") "), F.col("text")).alias("line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
