"""DuckDB SQL fragments for the oracle side of the correctness check.

They restate each rule in plain SQL over the supplied tables; the word lists
come from `vocspark.lexicon`, the logic is written out independently here.
"""

from __future__ import annotations

from vocspark import lexicon as lx
from vocspark.operators.enrich import slug
from vocspark.sources import fixture as fx


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def case_lookup(key: str, pairs, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {key} = {q(k)} THEN {q(v)}" for k, v in pairs)
    return f"CASE {whens} ELSE {default} END"


def _channel(col: str = "event_type") -> str:
    return case_lookup(col, fx.CHANNEL_BY_EVENT, q(fx.OTHER_CHANNEL))


FEEDBACK = f"""feedback AS (
  SELECT event_id + 1 AS id,
         {lst([t for _, t in fx.BANK])}[CAST(event_id % {len(fx.BANK)} AS INTEGER) + 1] AS text,
         {lst([s for s, _ in fx.BANK])}[CAST(event_id % {len(fx.BANK)} AS INTEGER) + 1] AS sentiment,
         CAST(3400 + (event_id * 37) % 6600 AS DOUBLE) / CAST(10000 AS DOUBLE) AS confidence,
         {_channel()} AS source,
         ts AS created_at,
         {_channel()} AS channel,
         'seg_' || CAST(user_id % {fx.N_SEGMENTS} AS VARCHAR) AS segment
  FROM events)"""

RAW_FEEDBACK = FEEDBACK + """,
raw_feedback AS (
  SELECT id,
         CASE WHEN id % 73 = 0 THEN NULL WHEN id % 79 = 0 THEN '' WHEN id % 71 = 0 THEN 'nan'
              ELSE text END AS text,
         CASE WHEN id % 97 = 0 THEN 'Unknown' ELSE sentiment END AS sentiment,
         CASE WHEN id % 83 = 0 THEN NULL WHEN id % 89 = 0 THEN CAST(1.5 AS DOUBLE)
              ELSE confidence END AS confidence,
         CASE WHEN id % 61 = 0 THEN NULL ELSE source END AS source,
         CASE WHEN id % 50 = 0 THEN NULL ELSE created_at END AS created_at,
         channel, segment
  FROM feedback)"""

WORD_RE = "[a-zA-Z'']+"          # SQL-escaped [a-zA-Z']+
CONTENT_RE = "[a-zA-Z'']{3,}"


def tokens(text: str = "text") -> str:
    return f"regexp_extract_all(lower({text}), '{WORD_RE}')"


def content_words(text: str = "text") -> str:
    return (f"list_filter(regexp_extract_all(lower({text}), '{CONTENT_RE}'), "
            f"lambda w: NOT list_contains({lst(lx.STOPWORDS)}, w))")


def bigrams(words: str) -> str:
    return (f"list_transform(range(1, len({words})), "
            f"lambda i: {words}[i] || ' ' || {words}[i + 1])")


def hits(toks: str, words) -> str:
    return f"len(list_distinct(list_filter({toks}, lambda w: list_contains({lst(words)}, w))))"


def argmax_first(names, cols, default) -> tuple[str, str]:
    top = f"greatest({', '.join(cols)})" if len(cols) > 1 else cols[0]
    whens = " ".join(f"WHEN {c} = {top} THEN {q(n)}" for n, c in zip(names, cols))
    return f"CASE WHEN {top} = 0 THEN {q(default)} {whens} END", top


EMO_COLS = [f"e_{slug(n)}" for n, _ in lx.EMOTION_LEXICON]
ASP_COLS = [f"a_{slug(n)}" for n, _ in lx.ASPECTS]


def _emotion_sql() -> tuple[str, str]:
    names = [n for n, _ in lx.EMOTION_LEXICON]
    col = dict(zip(names, EMO_COLS))
    neg = [n for n in names if n in lx.NEGATIVE_EMOTIONS]
    pos = [n for n in names if n in lx.POSITIVE_EMOTIONS]
    d = dict(lx.DEFAULT_EMOTION)
    ne, nt = argmax_first(neg, [col[n] for n in neg], d["Negative"])
    pe, pt = argmax_first(pos, [col[n] for n in pos], d["Positive"])
    ae, at = argmax_first(names, [col[n] for n in names], lx.NEUTRAL_DEFAULT_EMOTION)
    emotion = (f"CASE WHEN sentiment = 'Negative' THEN {ne} WHEN sentiment = 'Positive' "
               f"THEN {pe} ELSE {ae} END")
    top = (f"CASE WHEN sentiment = 'Negative' THEN {nt} WHEN sentiment = 'Positive' "
           f"THEN {pt} ELSE {at} END")
    return emotion, top


def signals_cte(src: str, name: str = "sig", text: str = "text") -> str:
    emo = ", ".join(f"{hits('toks', ws)} AS {c}"
                    for (_, ws), c in zip(lx.EMOTION_LEXICON, EMO_COLS))
    asp = ", ".join(f"{hits('toks', ws)} AS {c}" for (_, ws), c in zip(lx.ASPECTS, ASP_COLS))
    return f"""{name}_t AS (SELECT *, {tokens(text)} AS toks FROM {src}),
{name} AS (
  SELECT *, {emo}, {asp},
         len(list_filter(toks, lambda w: list_contains({lst(lx.INTENSIFIERS)}, w))) AS intens,
         length({text}) - length(replace({text}, '!', '')) AS exclaim,
         len(regexp_extract_all({text}, '\\b[A-Z]{{3,}}\\b')) AS caps
  FROM {name}_t)"""


def csat_sql(sentiment: str = "sentiment", conf: str = "confidence") -> str:
    c = f"CAST({conf} AS DECIMAL(5,4))"
    return (f"CASE WHEN {sentiment} = 'Positive' THEN CAST(round(4 + {c}, 2) AS DOUBLE) "
            f"WHEN {sentiment} = 'Negative' THEN CAST(round(2 - {c}, 2) AS DOUBLE) "
            f"ELSE CAST(3.0 AS DOUBLE) END")


def risk_sql() -> str:
    return (f"CASE WHEN sentiment = 'Negative' AND (intensity >= {lx.RISK_INTENSITY} "
            f"OR confidence >= CAST({lx.RISK_CONFIDENCE} AS DOUBLE)) THEN 'High' "
            f"WHEN sentiment = 'Negative' THEN 'Medium' WHEN sentiment = 'Neutral' THEN 'Low' "
            f"ELSE 'None' END")


def driver_sql() -> str:
    names = [n for n, _ in lx.ASPECTS]
    d, _ = argmax_first(names, ASP_COLS, lx.DEFAULT_DRIVER)
    return d


def enriched_ctes(src: str = "feedback", cols: str = "id, text, sentiment, confidence, "
                  "source, created_at, channel, segment") -> str:
    """CTEs ending in `enriched` = src columns + emotion, intensity, risk, driver, csat."""
    emotion, top = _emotion_sql()
    base = (f"CASE WHEN sentiment IS NOT DISTINCT FROM 'Neutral' THEN "
            f"{lx.INTENSITY_BASE_NEUTRAL} * confidence ELSE {lx.INTENSITY_BASE} * confidence END")
    raw = (f"{base} + {lx.INTENSITY_PER_HIT} * top + {lx.INTENSITY_PER_INTENSIFIER} * intens"
           f" + {lx.INTENSITY_PER_EXCLAIM} * exclaim + {lx.INTENSITY_PER_CAPS} * caps")
    return f"""{signals_cte(src)},
emo AS (SELECT *, {emotion} AS emotion, {top} AS top FROM sig),
inten AS (SELECT *, CAST(trunc(least(CAST({lx.INTENSITY_MAX} AS DOUBLE), {raw})) AS INTEGER)
          AS intensity FROM emo),
enriched AS (
  SELECT {cols}, emotion, intensity, {risk_sql()} AS risk, {driver_sql()} AS driver,
         {csat_sql()} AS csat
  FROM inten)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def share_sql(part: str, total: str) -> str:
    return (f"coalesce(CAST(100 AS DOUBLE) * (CAST({part} AS DOUBLE) / NULLIF({total}, 0)), "
            f"CAST(0 AS DOUBLE))")


def net_sql(p: str, n: str, total: str) -> str:
    return (f"coalesce(CAST(100 AS DOUBLE) * (CAST({p} AS DOUBLE) / NULLIF({total}, 0) - "
            f"CAST({n} AS DOUBLE) / NULLIF({total}, 0)), CAST(0 AS DOUBLE))")


def rule_scores_sql(text: str) -> tuple[str, str]:
    """(sentiment, confidence) of the rule scorer on an SQL text expression."""
    low = f"lower({text})"
    pos = " OR ".join(f"contains({low}, {q(w)})" for w in lx.RULE_POSITIVE_WORDS)
    neg = " OR ".join(f"contains({low}, {q(w)})" for w in lx.RULE_NEGATIVE_WORDS)
    sent = f"CASE WHEN {pos} THEN 'Positive' WHEN {neg} THEN 'Negative' ELSE 'Neutral' END"
    conf = (f"CASE WHEN {pos} THEN CAST({lx.RULE_POSITIVE_SCORE} AS DOUBLE) WHEN {neg} THEN "
            f"CAST({lx.RULE_NEGATIVE_SCORE} AS DOUBLE) ELSE CAST({lx.RULE_NEUTRAL_SCORE} AS DOUBLE) END")
    return sent, conf


def clean_sql(text: str) -> str:
    t = f"regexp_replace({text}, 'https?://\\S+|www\\.\\S+', 'http', 'g')"
    t = f"regexp_replace({t}, '@\\w+', '@user', 'g')"
    t = f"regexp_replace({t}, '\\s+', ' ', 'g')"
    return f"trim({t})"


def ws_trim_sql(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def sentences_sql(text: str) -> str:
    """Sentence list: split after . ! ? + whitespace, pieces trimmed, >= 4 chars."""
    marked = f"regexp_replace({ws_trim_sql(text)}, '([.!?])\\s+', '\\1' || chr(1), 'g')"
    return (f"list_filter(list_transform(string_split({marked}, chr(1)), "
            f"lambda p: {ws_trim_sql('p')}), lambda p: length(p) >= 4)")


def word_count_sql(text: str) -> str:
    t = ws_trim_sql(text)
    return f"CASE WHEN length({t}) = 0 THEN 0 ELSE len(string_split_regex({t}, '\\s+')) END"


def title_sql(s: str) -> str:
    """Python str.title() by characters."""
    ch = f"substring({s}, i, 1)"
    prev = f"substring({s}, i - 1, 1)"
    return (f"array_to_string(list_transform(range(1, length({s}) + 1), lambda i: "
            f"CASE WHEN i = 1 OR upper({prev}) = lower({prev}) THEN upper({ch}) "
            f"ELSE lower({ch}) END), '')")


def rule_scores_full_sql(text: str) -> str:
    """sentiment, confidence and the three class scores of the rule scorer."""
    sent, conf = rule_scores_sql(text)
    p, n, u = lx.RULE_POSITIVE_SCORE, lx.RULE_NEGATIVE_SCORE, lx.RULE_NEUTRAL_SCORE
    r = lambda t: round((1.0 - t) / 2, 4)
    d = lambda v: f"CAST({v!r} AS DOUBLE)"
    return (f"{sent} AS sentiment, {conf} AS confidence, "
            f"CASE WHEN {sent} = 'Positive' THEN {d(r(p))} WHEN {sent} = 'Negative' THEN {d(round(n, 4))} "
            f"ELSE {d(r(u))} END AS score_negative, "
            f"CASE WHEN {sent} = 'Positive' THEN {d(r(p))} WHEN {sent} = 'Negative' THEN {d(r(n))} "
            f"ELSE {d(round(u, 4))} END AS score_neutral, "
            f"CASE WHEN {sent} = 'Positive' THEN {d(round(p, 4))} WHEN {sent} = 'Negative' THEN {d(r(n))} "
            f"ELSE {d(r(u))} END AS score_positive")


TEXTS = """texts AS (
  SELECT doc_id AS id, 'document' AS origin, text FROM documents
  UNION ALL
  SELECT conv_id * 1000 + turn AS id, 'conversation' AS origin, text FROM conversations)"""


def aspects_list_sql(prefix: str = "a_") -> str:
    """Aspect names with >= 1 token hit, declared order (needs the sig CTE)."""
    items = ", ".join(f"CASE WHEN {c} > 0 THEN {q(n)} END"
                      for (n, _), c in zip(lx.ASPECTS, ASP_COLS))
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def fmt0_sql(x: str) -> str:
    return f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"


def fmt_signed0_sql(x: str) -> str:
    return (f"(CASE WHEN {x} < 0 THEN '-' ELSE '+' END || "
            f"CAST(CAST(abs(round_even({x}, 0)) AS BIGINT) AS VARCHAR))")


def fmt_pct0_sql(x: str) -> str:
    return f"({fmt0_sql(f'({x}) * CAST(100 AS DOUBLE)')} || '%')"
