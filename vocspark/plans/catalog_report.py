"""Queries for reports, history comparison, accounts and streams
(J1-J6, E34, D4, D5, D7, H2, C8, B26, L1, L2, K1-K4)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vocspark import lexicon as lx
from vocspark.operators import accounts as acc
from vocspark.operators import enrich as en
from vocspark.operators import report as rp
from vocspark.plans import sql as S
from vocspark.plans.catalog_agg import _gap_sql
from vocspark.plans.registry import query
from vocspark.session import materialize, shared_dir
from vocspark.sources import fixture as fx

TSF = "'%Y-%m-%d %H:%M:%S.%f'"
CUT = f"TIMESTAMP '{fx.HISTORY_CUTOFF} 00:00:00'"
FB_COLS = "id, text, sentiment, confidence, source, created_at, channel, segment"


def enr(spark, sf):
    return en.enrich_feedback(fx.feedback(spark, sf))


def batch_and_history(spark, sf, keep: bool = True):
    """Batch = items from the cutoff on; history = everything stored (the
    batch included, as when a batch is stored before it is reported).  The
    enriched batch is materialized once when a report reads it many times."""
    e = enr(spark, sf)
    cut = F.lit(fx.HISTORY_CUTOFF).cast("timestamp_ntz")
    batch = e.where(F.col("created_at") >= cut)
    return (materialize(batch) if keep else batch), e


BASE = S.with_(S.FEEDBACK, S.enriched_ctes(), f"batch AS (SELECT * FROM enriched WHERE created_at >= {CUT})")


def _kpi_cte(src: str = "batch") -> str:
    return f"""kpi AS (SELECT count(*) AS total,
  count(*) FILTER (WHERE sentiment = 'Positive') AS n_pos, count(*) FILTER (WHERE sentiment = 'Neutral') AS n_neu,
  count(*) FILTER (WHERE sentiment = 'Negative') AS n_neg, avg(confidence) AS avg_conf,
  count(*) FILTER (WHERE confidence < CAST({lx.REVIEW_THRESHOLD} AS DOUBLE)) AS n_low,
  count(*) FILTER (WHERE risk = 'High') AS n_high, avg(csat) AS avg_csat FROM {src}),
k AS (SELECT *, {S.share_sql('n_pos', 'total')} AS pct_pos, {S.share_sql('n_neu', 'total')} AS pct_neu,
  {S.share_sql('n_neg', 'total')} AS pct_neg, {S.net_sql('n_pos', 'n_neg', 'total')} AS net,
  {S.share_sql('n_low', 'total')} AS low_share FROM kpi)"""


def _words_cte(name: str, sentiment: str, n: int, min_items: int, src: str = "batch") -> str:
    gate = f"(SELECT count(*) FROM {src} WHERE sentiment = '{sentiment}') >= {min_items}"
    top = (f"SELECT word, count(*) AS c FROM (SELECT unnest({S.content_words()}) AS word FROM {src} "
           f"WHERE sentiment = '{sentiment}') GROUP BY word ORDER BY c DESC, word LIMIT {n}")
    return (f"{name} AS (SELECT CASE WHEN {gate} THEN coalesce((SELECT string_agg(word, ', ' "
            f"ORDER BY c DESC, word) FROM ({top})), '') ELSE '' END AS w)")


def _insight_ctes(src: str = "batch") -> str:
    f0, fs, fp = S.fmt0_sql, S.fmt_signed0_sql, S.fmt_pct0_sql
    mood = f"""CASE WHEN net >= {lx.NET_STRONG} THEN '**Overall Sentiment Is Strongly Positive** (Net Sentiment Score ' || {fs('net')} || '). Customers in this batch are largely happy — the priority is protecting and amplifying what works.'
  WHEN net >= {lx.NET_LEANS} THEN '**Overall Sentiment Leans Positive** (Net Sentiment Score ' || {fs('net')} || '), but the ' || {f0('pct_neg')} || '% negative slice is large enough to matter — address it before it grows.'
  WHEN net >= {lx.NET_SPLIT} THEN '**Sentiment Is Split** (Net Sentiment Score ' || {fs('net')} || '). Positive and negative voices are roughly balanced — customer experience is inconsistent, which usually points to an operational issue affecting only part of your customers.'
  ELSE '**Overall Sentiment Is Negative** (Net Sentiment Score ' || {fs('net')} || '). ' || {f0('pct_neg')} || '% of this batch is dissatisfied — treat this as an active customer-experience incident.' END"""
    thr = S.fmt_pct0_sql(f"CAST({lx.REVIEW_THRESHOLD} AS DOUBLE)")
    return f"""{_kpi_cte(src)},
{_words_cte('negw', 'Negative', 4, 3, src)},
{_words_cte('posw', 'Positive', 4, 3, src)},
me AS (SELECT coalesce((SELECT emotion FROM {src} WHERE risk = 'High' GROUP BY emotion
        ORDER BY count(*) DESC, emotion LIMIT 1), 'Anger') AS e),
chg AS ({_gap_sql('channel', src)}),
sgg AS ({_gap_sql('segment', src)}),
ins AS (
  SELECT 1 AS rule_no, 'mood' AS rule, {mood} AS line FROM k
  UNION ALL SELECT 2, 'complaint_themes', '**Complaint Themes:** negative feedback clusters around *' || w || '* — these words point at the likely root causes to investigate first.' FROM negw WHERE w <> ''
  UNION ALL SELECT 3, 'praised_strengths', '**Praised Strengths:** positive feedback repeatedly mentions *' || w || '* — proven strengths to feature in marketing and protect in any process change.' FROM posw WHERE w <> ''
  UNION ALL SELECT 4, 'large_neutral', '**Large Neutral Segment** (' || {f0('pct_neu')} || '%): neutral items often hide questions and pre-purchase signals — mining them is a low-cost revenue opportunity.' FROM k WHERE pct_neu >= {lx.NEUTRAL_LARGE_PCT}
  UNION ALL SELECT 5, 'certainty', '**Model Certainty:** average confidence is ' || {fp('avg_conf')} || '; ' || {f0('low_share')} || '% of items fall below your ' || {thr} || ' AI-confidence weighting and should get human review rather than automated handling.' FROM k
  UNION ALL SELECT 6, 'high_risk', '**' || CAST(n_high AS VARCHAR) || ' High-Risk Items Detected** — intensely negative feedback (dominant emotion: ' || (SELECT e FROM me) || '). These carry the highest churn and public-escalation risk; see the Urgent Alert Box.' FROM k WHERE n_high > 0
  UNION ALL SELECT 7, 'channel_gap', '**Channel Gap:** sentiment is weakest on **' || worst || '** (Net ' || {fs('worst_net')} || ') and strongest on **' || best || '** (Net ' || {fs('best_net')} || ') — channel-specific experience differences are worth investigating.' FROM chg
  UNION ALL SELECT 8, 'segment_watch', '**Segment Watch:** the **' || worst || '** segment has the lowest Net Sentiment (' || {fs('worst_net')} || ') — localised issues (logistics, language, expectations) may be at play.' FROM sgg)"""


@query("insights", "J1", BASE.rstrip() + ",\n" + _insight_ctes() + "\nSELECT rule_no, rule, line FROM ins")
def q_insights(spark, sf):
    batch, _ = batch_and_history(spark, sf, keep=False)
    return rp.insights(batch)


def _recs_cte(src: str = "batch") -> str:
    f0 = S.fmt0_sql
    return f"""recs AS (SELECT row_number() OVER (ORDER BY idx) AS rec_no, line FROM (
  SELECT 1 AS idx, 'Triage the Urgent Alert Box first — high-risk items are where churn and public escalations start; aim for a response within hours, not days.' AS line FROM k WHERE n_high > 0
  UNION ALL SELECT 2, 'Open a priority review of the complaint themes above; assign an owner and re-run this analysis after the fix ships to measure the effect.' FROM k WHERE pct_neg >= {lx.NEGATIVE_PRIORITY_PCT}
  UNION ALL SELECT 3, 'Search the History page for ''' || split_part(w, ', ', 1) || ''' to see whether this theme is new or a long-running issue.' FROM negw WHERE w <> ''
  UNION ALL SELECT 4, 'Respond to every negative item within 24 hours — recovery speed is the single strongest lever on churn.'
  UNION ALL SELECT 5, 'Invite the happiest customers (high-confidence Positive) to leave public reviews — social proof compounds.' FROM posw WHERE w <> ''
  UNION ALL SELECT 6, 'Set up a human review queue for the ' || {f0('low_share')} || '% low-confidence items before automating actions on this data.' FROM k WHERE low_share > {lx.LOW_CONFIDENCE_QUEUE_PCT}
  UNION ALL SELECT 7, 'Track the Net Sentiment Score over time in the History page — the trend matters more than any single batch.'))"""


@query("recommendations", "J2", BASE.rstrip() + ",\n" + _insight_ctes() + ",\n" + _recs_cte()
       + "\nSELECT CAST(rec_no AS INTEGER) AS rec_no, line FROM recs")
def q_recs(spark, sf):
    batch, _ = batch_and_history(spark, sf, keep=False)
    return rp.recommendations(batch)


HIST = f"""hist AS (SELECT count(*) AS n, {S.net_sql("count(*) FILTER (WHERE sentiment = 'Positive')",
                                                   "count(*) FILTER (WHERE sentiment = 'Negative')",
                                                   "count(*)")} AS net FROM enriched),
cmp AS (SELECT k.total AS batch_items, k.net AS batch_net, hist.n AS history_items, hist.net AS history_net,
  CASE WHEN hist.n > k.total THEN CASE WHEN k.net > hist.net + {lx.HISTORY_DEAD_BAND} THEN 'better than'
       WHEN k.net < hist.net - {lx.HISTORY_DEAD_BAND} THEN 'worse than' ELSE 'in line with' END END AS direction
  FROM k, hist)"""


@query("batch_vs_history", "D4", BASE.rstrip() + ",\n" + _kpi_cte() + ",\n" + HIST
       + "\nSELECT batch_items, batch_net, history_items, history_net, direction FROM cmp")
def q_vs_history(spark, sf):
    batch, hist = batch_and_history(spark, sf, keep=False)
    return rp.batch_vs_history(batch, hist)


def _summary_sql(history: bool = True) -> str:
    f0, fs, fp = S.fmt0_sql, S.fmt_signed0_sql, S.fmt_pct0_sql
    mood = (f"CASE WHEN net >= {lx.NET_STRONG} THEN 'strongly positive' WHEN net >= {lx.NET_LEANS} "
            f"THEN 'moderately positive' WHEN net >= {lx.NET_SPLIT} THEN 'mixed' "
            f"ELSE 'negative — action needed' END")
    compared = f"""  || coalesce((SELECT ' This batch is ' || direction || ' your overall history (Net Sentiment ' || {fs('batch_net')}
     || ' vs ' || {fs('history_net')} || ' all-time).' FROM cmp WHERE direction IS NOT NULL), '')""" if history else ""
    return f"""SELECT 'Analyzed **' || format('{{:,}}', total) || ' feedback items**: **' || {f0('pct_pos')}
  || '% Positive**, ' || {f0('pct_neu')} || '% Neutral, **' || {f0('pct_neg')} || '% Negative** — overall mood is **'
  || {mood} || '** (Net Sentiment Score ' || {fs('net')} || ', average model confidence ' || {fp('avg_conf')} || ').'
  || CASE WHEN (SELECT w FROM themes) <> '' THEN ' The main complaint themes are ' || (SELECT w FROM themes) || '.' ELSE '' END
{compared} AS summary FROM k"""


@query("executive_summary", "J3", BASE.rstrip() + ",\n" + _kpi_cte() + ",\n" + HIST + ",\n"
       + _words_cte("themes", "Negative", 3, 0) + "\n" + _summary_sql())
def q_summary(spark, sf):
    fb = fx.feedback(spark, sf)
    return rp.executive_summary(fb.where(F.col("created_at") >= F.lit(fx.HISTORY_CUTOFF).cast("timestamp_ntz")), fb)


def _key_metrics_sql() -> str:
    f0, fs, fp = S.fmt0_sql, S.fmt_signed0_sql, S.fmt_pct0_sql
    thr = fp(f"CAST({lx.REVIEW_THRESHOLD} AS DOUBLE)")
    rows = [
        ("Total Feedback Volume", "format('{:,}', total) || ' items'"),
        ("Positive / Neutral / Negative", f"{f0('pct_pos')} || '% / ' || {f0('pct_neu')} || '% / ' || {f0('pct_neg')} || '%'"),
        ("Net Sentiment Score (NSS)", f"{fs('net')} || '  (range -100 to +100)'"),
        ("Average CSAT Equivalent", "printf('%.2f', round_even(avg_csat, 2)) || ' / 5'"),
        ("Average Model Confidence", fp("avg_conf")),
        ("AI Confidence Weighting (Review Threshold)", thr),
        ("Items Needing Human Review", "format('{:,}', n_low)"),
        ("Urgent (High-Risk) Items", "format('{:,}', n_high)"),
    ]
    return "\nUNION ALL ".join(f"SELECT {i + 1} AS metric_no, {S.q(m)} AS metric, {v} AS value FROM k"
                               for i, (m, v) in enumerate(rows))


@query("key_metrics", "J5", BASE.rstrip() + ",\n" + _kpi_cte() + "\n" + _key_metrics_sql())
def q_key_metrics(spark, sf):
    batch, _ = batch_and_history(spark, sf, keep=False)
    return rp.key_metrics(batch)


@query("share_like_this", "D5", BASE + f"""SELECT b.id, b.sentiment,
  {S.share_sql('coalesce(h.n, 0)', '(SELECT count(*) FROM enriched)')} AS same_pct,
  (SELECT count(*) FROM enriched) AS history_items
FROM batch b LEFT JOIN (SELECT sentiment, count(*) AS n FROM enriched GROUP BY sentiment) h USING (sentiment)""")
def q_share_like(spark, sf):
    batch, hist = batch_and_history(spark, sf, keep=False)
    return rp.share_like_this(batch.select("id", "sentiment"), hist)


def _mix_sql(text: str = "text") -> tuple[str, str]:
    l_ = S.sentences_sql(text)
    lab = f"list_transform({l_}, lambda s: {S.rule_scores_sql(S.clean_sql('s'))[0]})"
    pos = f"CASE WHEN len({l_}) >= 2 THEN len(list_filter({lab}, lambda x: x = 'Positive')) ELSE 0 END"
    neg = f"CASE WHEN len({l_}) >= 2 THEN len(list_filter({lab}, lambda x: x = 'Negative')) ELSE 0 END"
    return pos, neg


_POS, _NEG = _mix_sql()


@query("mixed_sentiment", "E34", S.with_(S.FEEDBACK) + f"""SELECT id, positive_sentences, negative_sentences,
  positive_sentences > 0 AND negative_sentences > 0 AS mixed
FROM (SELECT id, {_POS} AS positive_sentences, {_NEG} AS negative_sentences FROM feedback)""")
def q_mixed(spark, sf):
    d = rp.with_sentence_mix(fx.feedback(spark, sf).select("id", "text"))
    return d.select("id", "positive_sentences", "negative_sentences", "mixed")


def _item_sql() -> str:
    (t1, b1, _), (t2, b2, _), (_, b3, _) = lx.CONFIDENCE_BANDS
    band = (f"CASE WHEN confidence >= CAST({t1} AS DOUBLE) THEN {S.q(b1)} WHEN confidence >= "
            f"CAST({t2} AS DOUBLE) THEN {S.q(b2)} ELSE {S.q(b3)} END")
    cols = FB_COLS + f", {S.aspects_list_sql()} AS al"
    return S.with_(S.FEEDBACK, S.enriched_ctes(cols=cols)) + f"""SELECT id, sentiment, confidence, {band} AS band,
  csat, emotion, intensity, risk, driver, array_to_string(al, '; ') AS aspects,
  coalesce(lower(al[1]), {S.q(lx.DEFAULT_TOPIC)}) AS topic, {S.word_count_sql('text')} AS words,
  length(text) AS characters, greatest(len({S.sentences_sql('text')}), 1) AS sentences,
  length(text) - length(replace(text, '!', '')) AS exclamations,
  {_POS} AS positive_sentences, {_NEG} AS negative_sentences,
  ({_POS}) > 0 AND ({_NEG}) > 0 AS mixed,
  {S.case_lookup('sentiment', lx.WHAT_IT_MEANS)} AS meaning,
  {S.case_lookup('sentiment', lx.RECOMMENDED_ACTION)} AS action FROM enriched"""


@query("item_report", "J6", _item_sql())
def q_item_report(spark, sf):
    return rp.item_report(en.enrich_feedback(fx.feedback(spark, sf), keep_aspects=True))


def _sections_sql() -> str:
    from vocspark.plans.catalog_agg import _aspect_hits_sql
    fs, fp = S.fmt_signed0_sql, S.fmt_pct0_sql
    piece = ", ".join(f"CASE WHEN {c} > 0 THEN CAST({c} AS VARCHAR) || ' {c}' END" for c in lx.CLASSES)

    def groups(no: int, key: str) -> str:
        return f"""SELECT {no}, '{key}s', CAST(dense_rank() OVER (ORDER BY {key}) AS INTEGER),
    '- ' || {key} || ': ' || CAST(items AS VARCHAR) || ' items, Net Sentiment ' || {fs('net')}
  FROM (SELECT {key}, count(*) AS items, {S.net_sql("count(*) FILTER (WHERE sentiment = 'Positive')",
                                                    "count(*) FILTER (WHERE sentiment = 'Negative')",
                                                    "count(*)")} AS net FROM batch GROUP BY {key})
  WHERE (SELECT count(DISTINCT {key}) FROM batch) > 1"""

    return f""",
ab AS (SELECT aspect, count(*) FILTER (WHERE sentiment = 'Negative') AS Negative,
         count(*) FILTER (WHERE sentiment = 'Neutral') AS Neutral,
         count(*) FILTER (WHERE sentiment = 'Positive') AS Positive
       FROM ({_aspect_hits_sql('batch')}) GROUP BY aspect)
SELECT 0 AS section_no, 'summary' AS section, 1 AS line_no, replace(summary, '**', '') AS line
  FROM ({_summary_sql(history=False)})
UNION ALL SELECT 1 AS section_no, 'insights' AS section, rule_no AS line_no, '- ' || replace(line, '**', '') AS line FROM ins
UNION ALL SELECT 2, 'recommendations', CAST(rec_no AS INTEGER), CAST(rec_no AS VARCHAR) || '. ' || line FROM recs
UNION ALL SELECT 3, 'risk_profile', r.rank, '- ' || r.risk || ': ' || CAST(coalesce(c.n, 0) AS VARCHAR) || ' items'
  FROM (VALUES (1, 'High'), (2, 'Medium'), (3, 'Low'), (4, 'None')) r(rank, risk)
  LEFT JOIN (SELECT risk, count(*) AS n FROM batch GROUP BY risk) c USING (risk)
UNION ALL SELECT 4, 'aspects', CAST(row_number() OVER (ORDER BY aspect) AS INTEGER),
  '- ' || aspect || ': ' || array_to_string(list_filter([{piece}], lambda x: x IS NOT NULL), ', ') FROM ab
UNION ALL {groups(5, 'channel')}
UNION ALL {groups(6, 'segment')}
UNION ALL SELECT 7, 'urgent_queue', CAST(row_number() OVER (ORDER BY confidence DESC, id) AS INTEGER),
  '- (' || {fp('confidence')} || ') ' || text
  FROM (SELECT * FROM batch WHERE risk = 'High' ORDER BY confidence DESC, id LIMIT 10)"""


@query("report_sections", "J4", BASE.rstrip() + ",\n" + _insight_ctes() + ",\n" + _recs_cte()
       + ",\n" + _words_cte("themes", "Negative", 3, 0) + _sections_sql())
def q_sections(spark, sf):
    batch, _ = batch_and_history(spark, sf)
    return rp.report_sections(batch)


# Accounts ---------------------------------------------------------------------------

def _accounts_cte() -> str:
    owner = "CASE WHEN c_custkey % 13 = 0 AND c_custkey > 0 THEN c_custkey - 1 ELSE c_custkey END"
    dom = f"{S.lst(fx.ACCOUNT_DOMAINS)}[CAST(({owner}) % {len(fx.ACCOUNT_DOMAINS)} AS INTEGER) + 1]"
    base = f"'customer.' || CAST(({owner}) AS VARCHAR) || '@' || {dom}"
    email = (f"CASE WHEN c_custkey % 29 = 0 THEN 'customer ' || CAST(({owner}) AS VARCHAR) || '@' || {dom} "
             f"WHEN c_custkey % 17 = 0 THEN '  ' || upper({base}) || ' ' ELSE {base} END")
    return f"""accounts AS (SELECT c_custkey AS id, c_name AS name, {email} AS email,
  CASE WHEN c_custkey % 5 = 0 THEN 'google' ELSE 'local' END AS provider,
  CASE WHEN c_custkey = 1 THEN 'admin' ELSE 'user' END AS role,
  CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS verified,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((c_custkey * 7919) % 100000 AS BIGINT)) AS created_at
FROM customer)"""


ACC = S.with_(_accounts_cte())
NORM = f"lower({S.ws_trim_sql('email')})"


def _check_sql() -> str:
    dom = f"string_split({NORM}, '@')[-1]"
    valid = f"regexp_matches({NORM}, {S.q(lx.EMAIL_PATTERN)})"
    sugg = (f"CASE WHEN {valid} AND NOT list_contains({S.lst(lx.COMMON_DOMAINS + lx.REAL_LOOKALIKE_DOMAINS)}, "
            f"{dom}) THEN list_filter({S.lst(lx.COMMON_DOMAINS)}, lambda k: damerau_levenshtein({dom}, k) = 1)[1] END")
    return (ACC + f"SELECT id, {NORM} AS email_norm, {valid} AS valid_format, {dom} AS domain, {sugg} AS suggestion, "
            f"CASE WHEN NOT {valid} THEN 'invalid format' WHEN ({sugg}) IS NOT NULL THEN 'domain typo' END AS reason "
            f"FROM accounts")


@query("check_emails", "L1+D7", _check_sql())
def q_check_emails(spark, sf):
    return acc.check_emails(fx.accounts(spark, sf)).select(
        "id", "email_norm", "valid_format", "domain", "suggestion", "reason")


@query("domain_typos_join", "D7", _check_sql())
def q_domain_typos(spark, sf):
    """The e-mail check with the known domains as a table."""
    return acc.check_emails_against(fx.accounts(spark, sf), acc.known_domains(spark)).select(
        "id", "email_norm", "valid_format", "domain", "suggestion", "reason")


@query("account_lookup_stored", "C8", ACC + f"SELECT id, email FROM accounts WHERE {NORM} = 'customer.2@yahoo.com'")
def q_account_lookup_stored(spark, sf):
    path = shared_dir(spark, "io", f"accounts-{uuid.uuid4().hex}")
    acc.write_accounts(fx.accounts(spark, sf), path)
    return acc.lookup_account(spark, path, " Customer.2@yahoo.com").select("id", "email")


@query("unique_accounts", "H2", ACC + f"""SELECT id, email, strftime(created_at, {TSF}) AS created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY {NORM} ORDER BY created_at, id) AS rn FROM accounts) WHERE rn = 1""")
def q_unique_accounts(spark, sf):
    return acc.unique_accounts(fx.accounts(spark, sf)).select("id", "email", "created_at")


@query("account_lookup", "C8", ACC + f"SELECT id, email FROM accounts WHERE {NORM} = 'customer.2@yahoo.com'")
def q_lookup(spark, sf):
    return acc.account_lookup(fx.accounts(spark, sf), " Customer.2@YAHOO.com ").select("id", "email")


@query("account_directory", "L2+G8+B26+B28", ACC + f"""SELECT id, name, {NORM} AS email, provider, role,
  CASE WHEN verified = 1 THEN 'Yes' WHEN verified = 0 THEN 'No' END AS verified,
  strftime(created_at, {TSF}) AS created_at,
  {S.title_sql(f"replace(split_part({NORM}, '@', 1), '.', ' ')")} AS display_name,
  upper(substring(name, 1, 1)) AS initials FROM accounts""")
def q_directory(spark, sf):
    return acc.account_directory(fx.accounts(spark, sf))


@query("account_count", "L2", ACC + "SELECT count(*) AS accounts FROM accounts")
def q_account_count(spark, sf):
    return acc.account_count(fx.accounts(spark, sf))


# Streams --------------------------------------------------------------------------

def _stream_input(spark, sf, max_files_per_trigger=None):
    """The fixture written as Parquet files under the shared folder, then
    read back as a stream (a fresh folder per run)."""
    from vocspark.streaming import stream as st
    base = shared_dir(spark, "stream-inputs", uuid.uuid4().hex)
    fb = fx.feedback(spark, sf).select("id", "text", "sentiment", "confidence", "source", "created_at")
    fb.repartition(8).write.parquet(base)
    return st.read_feedback_stream(spark, base, max_files_per_trigger=max_files_per_trigger), base


@query("stream_daily_counts", "K2", S.with_(S.FEEDBACK) + """
SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS date, sentiment, count(*) AS count
FROM feedback GROUP BY 1, 2""")
def q_stream_daily(spark, sf):
    from vocspark.streaming import stream as st
    s, base = _stream_input(spark, sf)
    q = st.stream_daily_counts(s, base + "-daily", checkpoint=base + "-ckpt")
    q.awaitTermination()
    return st.read_daily_counts(spark, base + "-daily")


@query("stream_daily_compacted", "K2", S.with_(S.FEEDBACK) + """
SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS date, sentiment, count(*) AS count
FROM feedback GROUP BY 1, 2""")
def q_stream_daily_compacted(spark, sf):
    """Daily counts of a stream of several triggers, read after compaction."""
    from vocspark.streaming import stream as st
    s, base = _stream_input(spark, sf, max_files_per_trigger=3)
    st.stream_daily_counts(s, base + "-daily", checkpoint=base + "-ckpt").awaitTermination()
    st.compact_daily_counts(spark, base + "-daily")
    return st.read_daily_counts(spark, base + "-daily")


@query("stream_daily_late", "K2", S.with_(S.FEEDBACK) + """, t AS (
  SELECT id, sentiment, created_at, CAST(created_at AS DATE) AS d FROM feedback),
w AS (SELECT max(created_at) - INTERVAL 1 DAY AS closed FROM t WHERE id % 2 = 0),
r AS (SELECT d, sentiment, id % 2 = 1 AND d + INTERVAL 1 DAY <= closed AS late FROM t, w)
SELECT strftime(d, '%Y-%m-%d') AS date, sentiment, count(*) FILTER (WHERE NOT late) AS count,
  count(*) FILTER (WHERE late) AS late FROM r GROUP BY 1, 2""")
def q_stream_daily_late(spark, sf):
    """Items of even ids arrive first, the others in a second trigger: those
    whose day the first one closed (a watermark of one day) are stored as late."""
    from vocspark.streaming import stream as st
    base = shared_dir(spark, "stream-inputs", uuid.uuid4().hex)
    fb = fx.feedback(spark, sf).select("id", "text", "sentiment", "confidence", "source", "created_at")
    for rest in (0, 1):
        fb.where(F.col("id") % 2 == rest).write.mode("append").parquet(base)
        st.stream_daily_counts(st.read_feedback_stream(spark, base), base + "-daily", checkpoint=base + "-ckpt",
                               watermark="1 day", late_path=base + "-late").awaitTermination()
    late = spark.read.parquet(base + "-late").select(
        F.to_date("event_time").alias("date"), "sentiment", F.lit(0).cast("long").alias("count"),
        F.lit(1).cast("long").alias("late"))
    counts = st.read_daily_counts(spark, base + "-daily").withColumn("late", F.lit(0).cast("long"))
    return counts.unionByName(late).groupBy("date", "sentiment").agg(
        F.sum("count").alias("count"), F.sum("late").alias("late"))


@query("stream_urgent", "K4", S.with_(S.FEEDBACK, S.enriched_ctes())
       + "SELECT id, emotion, intensity FROM enriched WHERE risk = 'High'")
def q_stream_urgent(spark, sf):
    from vocspark.streaming import stream as st
    s, base = _stream_input(spark, sf)
    out = base + "-urgent"
    st.stream_urgent(s, out, checkpoint=base + "-ckpt").awaitTermination()
    return spark.read.parquet(out).select("id", "emotion", "intensity")


@query("stream_kpis", "K3", S.with_(S.FEEDBACK)
       + "SELECT sentiment, count(*) AS count FROM feedback GROUP BY sentiment")
def q_stream_kpis(spark, sf):
    from vocspark.streaming import stream as st
    s, base = _stream_input(spark, sf)
    st.stream_kpis(s, base + "-kpis", checkpoint=base + "-ckpt").awaitTermination()
    return st.read_kpis(spark, base + "-kpis")


@query("stream_classify", "K1", S.with_(S.RAW_FEEDBACK) + f"""
SELECT id, {S.rule_scores_sql(S.clean_sql('text'))[0]} AS sentiment
FROM raw_feedback
WHERE text IS NOT NULL AND length(text) BETWEEN 1 AND {lx.MAX_TEXT_CHARS}""")
def q_stream_classify(spark, sf):
    from vocspark import schema as sc
    from vocspark.streaming import stream as st
    base = shared_dir(spark, "stream-inputs", uuid.uuid4().hex)
    raw = fx.raw_feedback(spark, sf).select("id", "text", "sentiment", "confidence", "source",
                                            "created_at")
    raw.repartition(8).write.parquet(base)
    s = spark.readStream.schema(sc.FEEDBACK_SCHEMA).parquet(base)
    st.stream_classify(s, base + "-out", base + "-rejects", checkpoint=base + "-ckpt").awaitTermination()
    return spark.read.parquet(base + "-out").select("id", "sentiment")
