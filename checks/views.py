"""Evaluation inputs derived from the driver's tables.

The tables hold no benchmark rows, responses or payloads, so these views make
them: every row of the source table is used, with its whole text, and integer
arithmetic on its keys decides which case it becomes. The text is the same for
Spark and DuckDB but for the marked places.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from scoreloom.functions.wording import WEAKNESS_STORED

from .registry_rows import ROWS

N_TASKS = len(ROWS)


def _quarters(question: str) -> str:
    """The whole text, cut into four options."""
    return f"""
      substr({question}, 1, q) AS opt_a, substr({question}, q + 1, q) AS opt_b,
      substr({question}, 2 * q + 1, q) AS opt_c, substr({question}, 3 * q + 1) AS opt_d"""


_GOLD = "substr('ABCD', CAST(n_chars % 4 AS INT) + 1, 1)"
_QUARTERED = "(SELECT *, CAST(floor(length(text) / 4) AS INT) AS q FROM documents) AS d"

VIEWS = {
    # Benchmark rows; a few labels are wrong, of other case or padded, some cells null.
    "items": f"""
SELECT doc_id AS item_id, source AS task, lang AS subject, n_chars,
       CASE WHEN n_chars % 7 = 0 THEN 'val' ELSE 'test' END AS split,
       text AS question, {_quarters('text')},
       CASE WHEN n_chars % 23 = 0 THEN '?' ELSE {_GOLD} END AS gold,
       CASE WHEN n_chars % 23 = 0 THEN 'E'
            WHEN n_chars % 5 = 0 THEN ' ' || lower({_GOLD}) || chr(10)
            WHEN n_chars % 19 = 0 THEN NULL
            ELSE {_GOLD} END AS loose_gold,
       CASE WHEN doc_id % 3 = 0 THEN CAST(n_chars % 4 AS VARCHAR(9))
            WHEN n_chars % 23 = 0 THEN 'x'
            ELSE {_GOLD} END AS mixed_gold,
       CASE WHEN n_chars % 29 = 0 THEN 'Z' ELSE substr('TFX', CAST(doc_id % 3 AS INT) + 1, 1)
            END AS bool_gold,
       CASE CAST(n_chars % 9 AS INT) WHEN 0 THEN '' WHEN 1 THEN ' ab ' WHEN 2 THEN 'ABCD'
            WHEN 3 THEN 'BA' WHEN 4 THEN 'bcd' || chr(10) WHEN 5 THEN 'C' WHEN 6 THEN NULL
            WHEN 7 THEN 'AD' ELSE 'E' END AS set_gold
FROM {_QUARTERED}""",
    # Three models; the text is null where a model gave no response.
    "responses": f"""
SELECT 'org/m' || CAST(midx AS VARCHAR(9)) AS model, task, item_id, gold,
       CASE style WHEN 0 THEN letter
                  WHEN 1 THEN '**' || letter || '**'
                  WHEN 2 THEN letter || ') because ' || question
                  WHEN 3 THEN 'First, A is weak.' || chr(10) || chr(10) || 'The answer is: ' || letter
                  WHEN 4 THEN 'final_' || letter
                  WHEN 5 THEN ''
                  WHEN 6 THEN NULL
                  WHEN 7 THEN question
                  WHEN 8 THEN 'A or B' || chr(10) || 'unsure'
                  ELSE question || chr(13) || chr(10) || ' (' || letter || ') ' || chr(133) || chr(160)
       END AS text
FROM (SELECT midx, doc_id AS item_id, source AS task, text AS question, {_GOLD} AS gold,
             (doc_id + midx) % 10 AS style,
             substr('ABCD', CAST((n_chars + CASE WHEN (doc_id * 31 + n_chars * 17 + midx * 13) % 10 < 6 + midx
                                                 THEN 0 ELSE 1 END) % 4 AS INT) + 1, 1) AS letter
      FROM (SELECT *, @each(0, 1, 2) AS midx FROM documents) AS d) AS r""",
    # Four choices per item, with ties.
    "choices": """
SELECT 'org/m' || CAST(midx AS VARCHAR(9)) AS model, source AS task, doc_id AS item_id, choice_idx,
       CAST(n_chars % 4 AS INT) AS gold_index,
       -CAST(((doc_id + n_chars) * choice_idx + n_chars + midx) % 4 AS DOUBLE) AS logprob
FROM (SELECT *, @each(0, 1, 2, 3) AS choice_idx
      FROM (SELECT *, @each(0, 1, 2) AS midx FROM documents) AS d) AS c""",
    # Three, four or sixteen choices per item, with ties and missing values; some items
    # have none at all.
    "many_choices": """
SELECT 'org/m' || CAST(midx AS VARCHAR(9)) AS model, source AS task, doc_id AS item_id, choice_idx,
       CAST(n_chars % n AS INT) AS gold_index,
       CASE WHEN (doc_id + choice_idx) % 5 = 0 OR doc_id % 17 = 0 THEN NULL
            ELSE -CAST(((doc_id + n_chars) * choice_idx + n_chars + midx) % 4 AS DOUBLE) END AS logprob
FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 16 END AS n,
             @each(0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15) AS choice_idx
      FROM (SELECT *, @each(0, 1) AS midx FROM documents) AS d) AS c
WHERE choice_idx < n""",
    # Responses as a run leaves them: some are missing, some belong to no task or item.
    "run": """
SELECT CASE WHEN kind < 4 THEN model END AS model, CASE WHEN kind = 1 THEN 'no:such' ELSE task END AS task,
       CASE WHEN kind = 2 THEN -1 - item_id ELSE item_id END AS item_id,
       CASE WHEN kind = 3 THEN 'B' || chr(10) || text ELSE text END AS text
FROM (SELECT *, @each(0, 1, 2, 3, 4) AS kind FROM @responses) AS r
WHERE (kind = 0 AND item_id % 11 <> 3) OR (kind > 0 AND item_id % 13 = kind)""",
    # Conversations of 450 turns with a system message.
    "long_chat": """
SELECT CAST(floor(doc_id / 150) AS BIGINT) AS conv_id, CAST((doc_id % 150) * 3 + midx AS BIGINT) AS turn,
       CASE WHEN doc_id % 150 = 0 AND midx = 0 THEN 'system' WHEN midx = 1 THEN 'assistant' ELSE 'user' END AS role,
       source || ' ' || CAST(n_chars AS VARCHAR(9)) AS text
FROM (SELECT *, @each(0, 1, 2) AS midx FROM documents) AS d""",
    # Scores that judges gave; some are missing.
    "judged": """
SELECT 'org/m' || CAST(midx AS VARCHAR(9)) AS model, lang AS dimension, doc_id AS item_id,
       CASE WHEN (n_chars + midx) % 12 < 11 THEN CAST((n_chars + midx) % 12 AS DOUBLE) END AS score
FROM (SELECT *, @each(0, 1, 2) AS midx FROM documents) AS d""",
    "weakness": """
SELECT doc_id AS item_id, source AS task, text AS description,
       'CWE-' || CAST(n_chars % 40 + 1 AS VARCHAR(9)) AS gold,
       '@stored Explain. CVE Description: ' || text AS prompt,
       CASE WHEN doc_id % 6 = 0 THEN 'not CWE-7 but CWE-' || CAST(n_chars % 40 + 1 AS VARCHAR(9)) || '.'
            WHEN doc_id % 6 = 1 THEN 'CWE-' || CAST(doc_id % 40 + 1 AS VARCHAR(9))
            WHEN doc_id % 6 = 2 THEN 'cwe-' || CAST(n_chars % 40 + 1 AS VARCHAR(9))
            WHEN doc_id % 6 = 3 THEN text
            WHEN doc_id % 6 = 4 THEN 'CWE-12, ' || text || ' CWE-' || CAST(n_chars % 40 + 1 AS VARCHAR(9)) || chr(10)
            ELSE NULL END AS text
FROM documents""",
    # Gold vectors bare or prefixed; stated ones valid, invalid, amid text or absent.
    "severity": """
SELECT item_id, task, description, CASE WHEN item_id % 3 = 0 THEN 'CVSS:3.1/' || g ELSE g END AS gold,
       CASE WHEN item_id % 7 = 0 THEN 'Vector: CVSS:3.0/' || p || ' done'
            WHEN item_id % 7 = 1 THEN p
            WHEN item_id % 7 = 2 THEN description
            WHEN item_id % 7 = 3 THEN NULL
            WHEN item_id % 7 = 4 THEN replace(p, 'AV:', 'AV:Z')
            WHEN item_id % 7 = 5 THEN g || ' or rather ' || p || chr(10) || description
            ELSE g END AS text
FROM (SELECT doc_id AS item_id, source AS task, text AS description,
        'AV:' || substr('NALP', CAST(n_chars % 4 AS INT) + 1, 1) || '/AC:' || substr('LH', CAST(doc_id % 2 AS INT) + 1, 1)
        || '/PR:' || substr('NLH', CAST(n_chars % 3 AS INT) + 1, 1) || '/UI:' || substr('NR', CAST(n_chars % 2 AS INT) + 1, 1)
        || '/S:' || substr('UC', CAST((doc_id + n_chars) % 2 AS INT) + 1, 1) || '/C:' || substr('NLH', CAST(doc_id % 3 AS INT) + 1, 1)
        || '/I:' || substr('NLH', CAST((n_chars + 1) % 3 AS INT) + 1, 1)
        || '/A:' || CASE WHEN doc_id % 31 = 0 THEN 'Q' ELSE substr('NLH', CAST((doc_id + n_chars) % 3 AS INT) + 1, 1) END AS g,
        'AV:' || substr('NALP', CAST(doc_id % 4 AS INT) + 1, 1) || '/AC:L/PR:' || substr('NLH', CAST(n_chars % 3 AS INT) + 1, 1)
        || '/UI:N/S:' || substr('UC', CAST(doc_id % 2 AS INT) + 1, 1) || '/C:H/I:' || substr('NLH', CAST(n_chars % 3 AS INT) + 1, 1)
        || '/A:L' AS p
      FROM documents) AS v""",
    "techniques": """
SELECT doc_id AS item_id, source AS task, text AS description,
       CASE WHEN doc_id % 11 = 0 THEN ''
            WHEN doc_id % 11 = 1 THEN text
            ELSE 'T' || CAST(1000 + n_chars % 30 AS VARCHAR(9)) || ', T'
                 || CAST(1000 + doc_id % 30 AS VARCHAR(9)) || '.002, x, T1059 (y)' END AS gold,
       CASE WHEN doc_id % 7 = 0 THEN 'none'
            WHEN doc_id % 7 = 1 THEN NULL
            ELSE 'Seen T' || CAST(1000 + n_chars % 30 AS VARCHAR(9)) || '.001 and T'
                 || CAST(1000 + (doc_id + n_chars) % 30 AS VARCHAR(9)) || '; AT10055. ' || text END AS text
FROM documents""",
    # Result files as rows: some malformed, some names missing, one entry no object.
    "payloads": """
SELECT 'run/org/m' || CAST(user_id % 4 AS VARCHAR(9)) || '/results_' || CAST(event_id AS VARCHAR(20)) || '.json' AS json_path,
       CASE WHEN event_id % 10 = 9 THEN '{bad'
            ELSE '{"config_general":{' || CASE WHEN event_id % 3 = 0 THEN '"model_name":"lab/team/m' || CAST(user_id % 4 AS VARCHAR(9)) || '"'
                                               WHEN event_id % 3 = 1 THEN '"model_config":{"model_name":"lab/team/m' || CAST(user_id % 4 AS VARCHAR(9)) || '"}'
                                               ELSE '"model_name":""' END
                 || '},"results":{"t:' || event_type || '|0":{"acc":' || CAST(event_id % 100 AS VARCHAR(9)) || ',"acc_stderr":' || CAST(user_id % 10 AS VARCHAR(9))
                 || '},"all":{"acc":' || CAST(event_id % 100 AS VARCHAR(9)) || '},"note":3}}' END AS payload
FROM events""",
    # Each document uses one task; some names are of no task.
    "usage": f"""
SELECT doc_id, CAST(doc_id % {N_TASKS} AS INT) AS position, n_chars,
       CASE WHEN n_chars % 3 = 0 THEN 'val' WHEN n_chars % 13 = 0 THEN 'dev' ELSE 'test' END AS split,
       CASE WHEN n_chars % 11 = 0 THEN 'x' ELSE '' END AS defect
FROM documents""",
    # Conversations with blank input, requests to quit and lost replies.
    "chat": """
SELECT conv_id, turn, role,
       CASE WHEN role = 'user' AND (conv_id + turn) % 9 = 0 THEN ' ' || chr(10) || chr(160)
            WHEN role = 'user' AND (conv_id * 3 + turn) % 17 = 4 THEN ' Quit' || chr(10)
            WHEN role = 'assistant' AND (conv_id + 2 * turn) % 13 = 5 THEN NULL
            ELSE '  ' || text || chr(10) END AS text
FROM conversations""",
}

SOURCES = ("documents", "events", "conversations")


def _fan_out(sql: str, to: str) -> str:
    return re.sub(r"@each\(([^)]*)\)", to, sql).replace("@stored", WEAKNESS_STORED)


VIEWS["run"] = VIEWS["run"].replace("@responses", f"({VIEWS['responses']}) AS given")


def duck_view(name: str) -> str:
    """A view as a DuckDB subquery."""
    return _fan_out(VIEWS[name].strip(), r"unnest([\1])")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a Spark DataFrame."""
    sql = _fan_out(VIEWS[name], r"explode(array(\1))")
    sql = sql.replace("{", "{{").replace("}", "}}")
    used = [t for t in SOURCES if f"FROM {t}" in sql]
    for source in used:
        sql = sql.replace(f"FROM {source}", f"FROM {{{source}}}")
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})
