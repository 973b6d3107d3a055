"""The same results in DuckDB SQL, written independently of the Spark expressions."""

from __future__ import annotations

import re
from html.entities import name2codepoint

from scoreloom.functions import severity, wording

from . import registry_rows as fixed
from .queries import EXAMPLES, PHRASES, SEEDS, STORED_INTRO, SYSTEM
from .views import duck_view

NL = "chr(10)"
SPACES = "||".join(
    f"chr({c})"
    for c in [*range(9, 14), *range(28, 33), 133, 160, 5760]
    + [*range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
)
LINES = r"[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
ALONE = r"(?:^|[^\p{L}\p{N}_])([ABCD])(?:$|[^\p{L}\p{N}_])"
VECTOR = (
    r"(?:CVSS:3\.[01]/)?AV:[A-Za-z]+/AC:[A-Za-z]+/PR:[A-Za-z]+/UI:[A-Za-z]+"
    r"/S:[A-Za-z]+/C:[A-Za-z]+/I:[A-Za-z]+/A:[A-Za-z]+"
)


def lit(text: str) -> str:
    """A text as an SQL expression; line feeds are spelt out."""
    parts = ["'" + p.replace("'", "''") + "'" for p in text.split("\n")]
    return f" || {NL} || ".join(parts)


def strip(x: str) -> str:
    return f"trim({x}, {SPACES})"


def src(name: str) -> str:
    return f"({duck_view(name)}) AS {name}"


def values(rows, columns: str) -> str:
    def one(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        return str(v) if isinstance(v, (int, float)) else lit(str(v))

    body = ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)
    name = columns.split("(")[0]
    return f"(SELECT * FROM (VALUES {body}) AS {columns}) AS {name}"


ORACLE: dict[str, str] = {}


def add(key: str, sql: str) -> None:
    ORACLE[key] = re.sub(r"\n\s*\n", "\n", sql.strip())


# Registry rows as a SQL table

REG = values(
    fixed.ROWS,
    "reg(position, task, category, repo, subset, metrics, available_splits, few_shot_split, "
    "few_shot_rule, generation_size, n_stops, evaluation_split)",
)
USED = f"{src('usage')} JOIN {REG} USING (position)"

add(
    "scan_benchmark",
    f"""
    SELECT u.doc_id, reg.task
    FROM (SELECT doc_id, repo, subset, split FROM {USED}) AS u
    JOIN {REG} ON reg.repo = u.repo AND reg.subset = u.subset AND reg.evaluation_split = u.split
    """,
)
add(
    "plan_distinct_datasets",
    f"""
    SELECT repo, subset, task, position FROM (
      SELECT repo, subset, task, doc_id AS position,
             row_number() OVER (PARTITION BY repo, subset ORDER BY doc_id) AS rn
      FROM {USED}) AS x WHERE rn = 1
    """,
)
add(
    "task_registry",
    f"""
    SELECT reg.position, task, repo, subset, metrics, available_splits, few_shot_split, few_shot_rule,
           generation_size, n_stops, coalesce(n, 0) AS n_items
    FROM {REG} LEFT JOIN (SELECT position, count(*) AS n FROM {src('usage')} GROUP BY 1) AS u
      ON u.position = reg.position
    """,
)
add(
    "task_variant_rules",
    f"""
    WITH named AS (SELECT doc_id, task || defect AS task, defect = '' AS known,
                          metrics, generation_size AS size FROM {USED})
    SELECT doc_id, task, known,
           CASE WHEN known THEN regexp_replace(task, '_ori', '', 'g') END AS base_name,
           CASE WHEN known THEN CASE WHEN metrics = 'loglikelihood' THEN 'loglikelihood'
                                     ELSE 'generative' END END AS mode,
           CASE WHEN known THEN size END AS generation_size
    FROM named
    """,
)
add(
    "task_catalogue",
    f"""
    SELECT c.category, n_tasks, tasks, n_items
    FROM (SELECT category, count(*) AS n_tasks, string_agg(task, ',' ORDER BY position) AS tasks
          FROM {REG} WHERE NOT starts_with(task, 'cti_bench_ori') GROUP BY 1
          UNION ALL SELECT 'Curated suites', 4, 'house_base,house_instruct,related_base,related_instruct') AS c
    LEFT JOIN (SELECT category, count(*) AS n_items FROM {USED} GROUP BY 1) AS u USING (category)
    """,
)
SUITES = values(
    [(suite, task, shots) for suite, (tasks, shots) in fixed.SUITES.items() for task in tasks],
    "s(suite, task, shots)",
)
add(
    "curated_suites",
    f"""
    SELECT suite, count(*) AS n_tasks, count(reg.task) AS n_known, max(shots) AS shots,
           CAST(sum(n) AS BIGINT) AS n_items
    FROM {SUITES} LEFT JOIN {REG} ON reg.task = s.task
    LEFT JOIN (SELECT task, count(*) AS n FROM {USED} GROUP BY 1) AS u ON u.task = s.task
    GROUP BY suite
    """,
)

# Sources

SPEC = """SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN ' tasks/' || source || '.txt'
             WHEN doc_id % 9 = 1 THEN text || ', , a:b|5,c:d|,' || lang
             ELSE text END AS spec FROM documents"""
add(
    "normalize_task_spec",
    f"""
    WITH s AS ({SPEC}),
    parts AS (
      SELECT doc_id, spec LIKE ' tasks/%' OR {strip('spec')} LIKE 'tasks/%' AS is_list,
             CASE WHEN {strip('spec')} LIKE 'tasks/%' THEN [{strip('spec')}]
                  ELSE list_filter(list_transform(string_split(spec, ','), lambda x: {strip('x')}),
                                   lambda x: x <> '') END AS ps FROM s),
    flat AS (SELECT doc_id, is_list, unnest(ps) AS p, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS position
             FROM parts)
    SELECT doc_id, position,
           CASE WHEN is_list OR regexp_full_match(string_split(p, '|')[-1], '\\p{{Nd}}+') THEN p
                ELSE p || '|3' END AS task_spec
    FROM flat
    """,
)
add(
    "scan_task_list",
    """
    SELECT source AS task, CAST(n_chars % 6 AS INTEGER) AS shots, count(*) AS lines
    FROM documents GROUP BY 1, 2
    """,
)
add("parse_results_tolerant", f"SELECT json_path, json_valid(payload) AS decoded FROM {src('payloads')}")

# Validation

add(
    "require_columns",
    f"""
    SELECT item_id, CASE WHEN loose_gold IS NULL OR set_gold IS NULL THEN 'missing required value' END AS reason,
           CASE WHEN loose_gold IS NULL OR set_gold IS NULL THEN
             concat_ws(',', CASE WHEN loose_gold IS NULL THEN 'loose_gold' END,
                       CASE WHEN set_gold IS NULL THEN 'set_gold' END) END AS missing
    FROM {src('items')}
    """,
)


def index_of(x: str, domain=fixed.FOUR) -> str:
    cases = " ".join(f"WHEN '{d}' THEN {i}" for i, d in enumerate(domain))
    return f"CAST(CASE {x} {cases} END AS INTEGER)"


def loose(x: str) -> str:
    return f"upper({strip(x)})"


MIXED = (
    "CAST(CASE mixed_gold WHEN '0' THEN 0 WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 3 "
    "WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2 WHEN 'D' THEN 3 END AS INTEGER)"
)
add("gold_index_strict", f"SELECT item_id, {index_of('gold')} AS gold_index FROM {src('items')}")
add("gold_index_normalized", f"SELECT item_id, {index_of(loose('loose_gold'))} AS gold_index FROM {src('items')}")
add("gold_index_mixed", f"SELECT item_id, {MIXED} AS gold_index FROM {src('items')}")
SET_INDEX = index_of(loose("set_gold"), fixed.SETS)
add(
    "gold_set_or_skip",
    f"""SELECT item_id, gold_index, CASE WHEN gold_index IS NULL THEN 'unknown answer set' END AS reason
    FROM (SELECT item_id, {SET_INDEX} AS gold_index FROM {src('items')}) AS x""",
)
# A text is missing where n_chars is a multiple of 5, letter B where it is one of 3.
add(
    "require_all_choices",
    f"""
    SELECT item_id, concat_ws(',', CASE WHEN n_chars % 3 = 0 THEN 'B' END,
                              CASE WHEN n_chars % 5 = 0 THEN 'C' END) AS missing
    FROM {src('items')}
    """,
)
HOLES = f"""(SELECT item_id AS "row", CASE WHEN item_id >= 20 THEN item_id END AS item_id,
      CASE WHEN task <> 'src19' THEN task END AS task, question FROM {src('items')}) AS h"""
add(
    "limit_per_task",
    f"""
    SELECT 'first' AS part, "row", item_id, task, question FROM (
      SELECT *, row_number() OVER (PARTITION BY task ORDER BY item_id NULLS LAST) AS rn FROM {HOLES}) AS x
    WHERE rn <= 7
    UNION ALL SELECT 'every', "row", item_id, task, question FROM {HOLES}
    """,
)


def lettered(*texts: str) -> str:
    return f" || {NL} || ".join(f"'{x}. ' || {t}" for x, t in zip("ABCD", texts))


FOUR = ("opt_a", "opt_b", "opt_c", "opt_d")


def mcq(asked: str, *texts: str) -> str:
    return f"{lit(asked)} || {NL} || 'Question: ' || question || {NL} || {lettered(*texts)} || {NL} || 'Answer:'"


add(
    "attach_few_shots",
    f"""
    WITH q AS (SELECT task, item_id, split, {mcq(wording.LETTER_ASKED, *FOUR)} AS query,
                      ' ' || gold AS answer FROM {src('items')}),
    ex AS (SELECT task, item_id, query || answer AS shown, split FROM q),
    val_pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY item_id) AS rn
                                FROM ex WHERE split = 'val') AS x WHERE rn <= 2),
    own_pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY item_id) AS rn
                                FROM ex) AS x WHERE rn <= 2),
    val_block AS (SELECT task, string_agg(shown, {NL} || {NL} ORDER BY item_id) AS block FROM val_pool GROUP BY 1)
    SELECT 'val' AS pool, item_id, coalesce(block || {NL} || {NL}, '') || query AS query
    FROM q LEFT JOIN val_block USING (task) WHERE split = 'test'
    UNION ALL
    SELECT 'own', q.item_id, coalesce(min_by(o.shown, o.item_id) || {NL} || {NL}, '') || q.query
    FROM q LEFT JOIN own_pool AS o ON o.task = q.task AND o.item_id <> q.item_id
    GROUP BY q.item_id, q.query
    """,
)


def cut(x: str, stop: str) -> str:
    return f"string_split({x}, {stop})[1]"


DOT = "'. '"
BECAUSE = "'because'"
add(
    "apply_stop_sequences",
    f"""
    SELECT model, item_id, {cut('text', NL)} AS one_line,
           CASE WHEN item_id % 2 = 0 THEN {cut(cut('text', NL), DOT)} ELSE {cut('text', BECAUSE)} END AS by_row
    FROM {src('responses')}
    """,
)

# Prompts


def _cells(choices: list[str] | str, extras: dict[str, str]) -> tuple[str, str]:
    shown = choices if isinstance(choices, str) else lit(",".join(" " + x for x in choices))
    pairs = " || ';' || ".join(f"'{k}=' || coalesce({v}, '-')" for k, v in extras.items())
    return shown, pairs or "CAST(NULL AS VARCHAR)"


def accepted(
    select: str,
    source: str,
    index: str,
    gold: str,
    where: str = "TRUE",
    told: str | None = None,
    choices: list[str] | str = fixed.FOUR,
    extras: dict[str, str] | None = None,
    required: list[str] = (),
) -> str:
    """Accepted rows with all their cells, and rejected ones with their reason.

    ``where`` says whether all choices that are needed have a text; an absent ``required``
    value is reported before that, a label without an index after it.
    """
    told = "CAST(NULL AS VARCHAR)" if told is None else told
    shown, pairs = _cells(choices, extras or {})
    absent = " OR ".join(f"{c} IS NULL" for c in required) or "FALSE"
    return f"""SELECT item_id, CASE WHEN reason IS NULL THEN query END AS query,
        CASE WHEN reason IS NULL THEN instruction END AS instruction,
        CASE WHEN reason IS NULL THEN choices END AS choices,
        CASE WHEN reason IS NULL THEN gold_index END AS gold_index,
        CASE WHEN reason IS NULL THEN gold END AS gold,
        CASE WHEN reason IS NULL THEN extras END AS specific, reason FROM (
      SELECT item_id, query, instruction, gold_index, {gold} AS gold, {shown} AS choices, {pairs} AS extras,
             CASE WHEN {absent} THEN 'missing required value'
                  WHEN NOT ({where}) THEN 'choice without text'
                  WHEN gold_index IS NULL THEN 'invalid label' END AS reason FROM (
        SELECT *, {index} AS gold_index, {select} AS query, {told} AS instruction FROM {source}) AS x) AS y"""


LETTER = "' ' || substr('ABCD', gold_index + 1, 1)"
INTRO = wording.SUBJECT_INTRO
TOPIC = f"{lit(INTRO[0])} || subject || ' ' || replace(task, '_', ' ') || {lit(INTRO[1])}"
add(
    "prompt_p1_subject_mcq",
    accepted(
        f"{TOPIC} || {NL} || {NL} || 'Question: ' || question || {NL} || {lettered(*FOUR)} || {NL} || 'Answer:'",
        src("items"),
        MIXED,
        LETTER,
        told=TOPIC,
        required=["subject", "question", "mixed_gold"],
    ),
)


def both(first: str, second: str, name: str = "direct") -> str:
    return f"SELECT *, TRUE AS {name} FROM ({first}) AS a UNION ALL SELECT *, FALSE AS {name} FROM ({second}) AS b"


LOOSE_INDEX = index_of(loose("loose_gold"))
STORED = f"{lit(STORED_INTRO)} || question || {NL} || "
THREAT = {"extras": {"url": "NULL", "Question": "NULL"}, "required": ["question", "loose_gold"]}
GIVEN = {
    "choices": "gold",
    "extras": {"url": "NULL", "Description": "description", "GT": "gold"},
    "required": ["description", "gold"],
}
add(
    "prompt_p2_cti_mcq",
    both(
        accepted(STORED + lit(wording.THREAT_DIRECT), src("items"), LOOSE_INDEX, LETTER, told=lit(wording.THREAT_ASKED), **THREAT),
        accepted(STORED + lit(wording.THREAT_LAST_LINE), src("items"), LOOSE_INDEX, LETTER, told=lit(wording.THREAT_ASKED), **THREAT),
    ),
)


def described(asked: str, cue: str) -> str:
    return f"{lit(asked)} || {NL} || {NL} || 'CVE Description: ' || description || ' ' || {lit(cue)}"


ZERO = "CAST(0 AS INTEGER)"
add(
    "prompt_p3_weakness",
    both(
        accepted(described(wording.WEAKNESS_ASKED, wording.WEAKNESS_CUE), src("weakness"), ZERO, "gold", told=lit(wording.WEAKNESS_ASKED), **GIVEN),
        accepted(
            f"{lit(wording.WEAKNESS_ASKED)} || ' Explain. CVE Description: ' || description",
            src("weakness"),
            ZERO,
            "gold",
            told=lit(wording.WEAKNESS_ASKED),
            **GIVEN,
        ),
    ),
)
add(
    "prompt_p4_severity",
    both(
        accepted(described(wording.SEVERITY_ASKED, wording.SEVERITY_CUE), src("severity"), ZERO, "gold", told=lit(wording.SEVERITY_ASKED), **GIVEN),
        accepted(f"{lit(STORED_INTRO)} || description", src("severity"), ZERO, "gold", told=lit(wording.SEVERITY_ASKED), **GIVEN),
    ),
)
TECHNIQUES = {**GIVEN, "extras": {"url": "NULL", "Platform": "NULL", "Description": "NULL", "GT": "gold"}}
add(
    "prompt_p5_techniques",
    both(
        accepted(
            f"{lit(STORED_INTRO)} || description || {NL} || {lit(wording.TECHNIQUES_CUE)}",
            src("techniques"),
            ZERO,
            "gold",
            told=lit(wording.TECHNIQUES_ASKED),
            **TECHNIQUES,
        ),
        accepted(f"{lit(STORED_INTRO)} || description", src("techniques"), ZERO, "gold", told=lit(wording.TECHNIQUES_ASKED), **TECHNIQUES),
    ),
)
add(
    "prompt_p6_inline_options",
    accepted(
        f"'Question: ' || question || {NL} || 'Options: B) ' || opt_b || ', A) ' || opt_a || ', D) ' || opt_d "
        f"|| ', C) ' || CASE WHEN n_chars % 5 = 0 THEN 'None' ELSE opt_c END || {NL} || {NL} "
        f"|| {lit(wording.INLINE_CUE)} || {NL} || 'Answer:'",
        src("items"),
        LOOSE_INDEX,
        LETTER,
        required=["question", "loose_gold"],
    ),
)
STRICT_INDEX = index_of("gold")
add(
    "prompt_p7_mcq_list",
    accepted(
        mcq(wording.LETTERS_ASKED, *FOUR), src("items"), STRICT_INDEX, LETTER, told=lit(wording.LETTERS_ASKED), extras={"id": "NULL"}
    ),
)
add(
    "prompt_p8_boolean",
    accepted(
        f"question || {NL} || 'Answer:'",
        src("items"),
        index_of("bool_gold", fixed.THREE),
        "' ' || substr('TFX', gold_index + 1, 1)",
        choices=fixed.THREE,
        extras={"question": "question", "url": "NULL"},
    ),
)
add(
    "prompt_p9_mcq_list_alt",
    accepted(
        mcq(wording.LETTER_ASKED, *FOUR[:3]), src("items"), STRICT_INDEX, LETTER, told=lit(wording.LETTER_ASKED), extras={"id": "NULL"}
    ),
)


def answer_set(block: str) -> str:
    return (
        f"{lit(wording.ANSWER_SET_ASKED)} || {NL} || {NL} || {block} || 'Question: ' || question || ' ' "
        f"|| opt_a || ' ' || opt_b || ' ' || opt_c || ' ' || opt_d || {NL} || 'Answer:'"
    )


MANY = {
    "where": "n_chars % 5 <> 0",
    "told": lit(wording.ANSWER_SET_ASKED),
    "choices": fixed.SETS,
    "extras": {"id": "NULL", "topic": "NULL"},
    "required": ["question", "set_gold"],
}
SET_GOLD = f"' ' || {loose('set_gold')}"
add(
    "prompt_p10_multi_answer",
    both(
        accepted(answer_set(f"{lit(EXAMPLES)} || {NL}"), src("items"), SET_INDEX, SET_GOLD, **MANY),
        accepted(answer_set("''"), src("items"), SET_INDEX, SET_GOLD, **MANY),
        "examples",
    ),
)


def in_context(context: str) -> str:
    return (
        f"{lit(wording.LETTERS_ASKED)} || {NL} || {context} || 'Question: ' || question || {NL} "
        f"|| {lettered(*FOUR)} || {NL} || 'Answer:'"
    )


WHOLE = "n_chars % 5 <> 0 AND n_chars % 3 <> 0"
add(
    "prompt_p11_context_mcq",
    both(
        accepted(
            in_context(
                f"CASE WHEN n_chars % 2 = 0 THEN 'Context: ' || subject || {NL} || {NL} ELSE '' END"
            ),
            src("items"),
            STRICT_INDEX,
            LETTER,
            WHOLE,
            lit(wording.LETTERS_ASKED),
            extras={"id": "NULL"},
        ),
        accepted(in_context("''"), src("items"), STRICT_INDEX, LETTER, WHOLE, lit(wording.LETTERS_ASKED), extras={"id": "NULL"}),
        "context",
    ),
)

# Extraction

LETTERED = f"""
    lined AS (SELECT model, task, item_id, gold, text,
                list_reverse(list_filter(list_transform(regexp_split_to_array(text, '{LINES}'),
                                                        lambda x: {strip('x')}), lambda x: x <> ''))[1:5] AS tail
              FROM {src('responses')}),
    found AS (SELECT *, list_filter(list_transform(list_transform(tail, lambda x: replace(x, '**', ' ')),
                lambda x: CASE WHEN regexp_matches(x, '{ALONE}') THEN regexp_extract(x, '{ALONE}', 1)
                               WHEN regexp_matches(x, '_[ABCD]$') THEN right(x, 1) END),
                lambda x: x IS NOT NULL) AS hits,
                list_distinct(regexp_extract_all(text, '[ABCD]')) AS capitals FROM lined),
    lettered AS (SELECT *, CASE WHEN len(hits) > 0 THEN hits[1]
                                WHEN len(capitals) = 1 THEN capitals[1] END AS letter FROM found)"""
add("extract_choice_letter", f"WITH {LETTERED} SELECT model, item_id, letter FROM lettered")


def last_match(x: str, pattern: str) -> str:
    return f"regexp_extract_all({x}, '{pattern}')[-1]"


CWE = r"CWE-\p{Nd}+"
add(
    "extract_weakness_id",
    f"""
    SELECT item_id, coalesce({last_match('text', CWE)}, text) AS weakness,
           coalesce(regexp_matches(text, '{CWE}'), FALSE) AS found FROM {src('weakness')}
    """,
)
add(
    "extract_severity_vector",
    f"""
    SELECT item_id, coalesce({last_match('text', VECTOR)}, text) AS vector,
           coalesce(regexp_matches(text, '{VECTOR}'), FALSE) AS found FROM {src('severity')}
    """,
)


def first_seen(x: str) -> str:
    """Distinct list entries in order of first appearance."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


FOUND = "list_transform(regexp_extract_all(text, 'T\\p{Nd}{4}(?:\\.\\p{Nd}{3})?'), lambda v: v[1:5])"
GOLDEN = (
    f"list_transform(list_filter(list_transform(string_split(gold, ','), lambda v: {strip('v')}), "
    "lambda v: regexp_matches(v, '^T\\p{Nd}{4}')), lambda v: string_split(v, '.')[1])"
)
add(
    "extract_techniques",
    f"SELECT item_id, array_to_string({first_seen('f')}, ',') AS techniques "
    f"FROM (SELECT item_id, {FOUND} AS f FROM {src('techniques')}) AS x",
)
add(
    "parse_technique_list",
    f"SELECT item_id, array_to_string({GOLDEN}, ',') AS techniques FROM {src('techniques')}",
)


def metric_case(x: str, weights: dict) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in weights.items()) + " END"


def base_scores(source: str, vector: str) -> str:
    """Base score of a vector per item, null for vectors that are not valid.

    The derived vectors keep the usual order, so one full match tells validity.
    """
    s = severity
    value = {m: f"regexp_extract(v, '(?:^|/){m}:([A-Z])', 1)" for m in s.BASE_METRICS}
    got = ", ".join(f"{value[m]} AS m_{m}" for m in s.BASE_METRICS)
    iss = " * ".join(f"(1 - {metric_case(f'm_{m}', s.IMPACT)})" for m in "CIA")
    pr = (
        f"CASE WHEN m_S = 'C' THEN {metric_case('m_PR', s.PRIVILEGES_CHANGED)} "
        f"ELSE {metric_case('m_PR', s.PRIVILEGES_UNCHANGED)} END"
    )
    return f"""
      SELECT item_id, CASE WHEN NOT ok THEN NULL WHEN imp <= 0 THEN 0
             WHEN n % 10000 = 0 THEN n / 100000.0::DOUBLE ELSE (floor(n / 10000.0::DOUBLE) + 1) / 10.0::DOUBLE END AS score
      FROM (SELECT *, CAST(round(least(10, CASE WHEN m_S = 'C' THEN 1.08::DOUBLE ELSE 1 END * (imp + ex)) * 100000) AS BIGINT) AS n
        FROM (SELECT *, CASE WHEN m_S = 'C' THEN 7.52::DOUBLE * (iss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(iss - 0.02::DOUBLE, 15)
                             ELSE 6.42::DOUBLE * iss END AS imp,
                     8.22::DOUBLE * {metric_case('m_AV', s.ATTACK_VECTOR)} * {metric_case('m_AC', s.ATTACK_COMPLEXITY)}
                       * {pr} * {metric_case('m_UI', s.USER_INTERACTION)} AS ex
          FROM (SELECT *, 1 - {iss} AS iss
            FROM (SELECT item_id, v, {got}, coalesce(regexp_full_match(v,
                    'AV:[NALP]/AC:[LH]/PR:[NLH]/UI:[NR]/S:[UC]/C:[NLH]/I:[NLH]/A:[NLH]'), FALSE) AS ok
              FROM (SELECT item_id, regexp_replace({vector}, '^CVSS:3\\.[01]/', '') AS v FROM {source}) AS a) AS b) AS c) AS d) AS e"""


add("cvss_base_score", f"SELECT item_id, gold, score FROM {src('severity')} JOIN ({base_scores(src('severity'), 'gold')}) AS s USING (item_id)")

# Scores

add(
    "score_mcq_regex",
    f"WITH {LETTERED} SELECT model, item_id, CASE WHEN letter = gold THEN 1.0::DOUBLE ELSE 0 END AS value FROM lettered",
)
add(
    "score_weakness_id",
    f"""
    SELECT item_id, CASE WHEN coalesce({last_match(strip('text'), CWE)}, {strip('text')}) = gold THEN 1.0::DOUBLE ELSE 0 END AS value
    FROM {src('weakness')}
    """,
)
EM = f"CASE WHEN text <> '' AND {strip('text')} = {strip('gold')} THEN 1.0::DOUBLE ELSE 0 END"
PEM = f"CASE WHEN text <> '' AND starts_with({strip('text')}, {strip('gold')}) THEN 1.0::DOUBLE ELSE 0 END"
ACC = "CASE WHEN letter = gold THEN 1.0::DOUBLE ELSE 0 END"
add("score_exact_match", f"SELECT model, item_id, {EM} AS value FROM {src('responses')}")
add(
    "score_prefix_match",
    f"""
    SELECT model, item_id, {PEM} AS value, {strip('gold')} = '' AS empty_gold
    FROM (SELECT model, item_id, text, CASE WHEN item_id % 41 = 0 THEN ' ' ELSE gold END AS gold
          FROM {src('responses')}) AS r
    """,
)
PICKED = f"""SELECT model, task, item_id, gold_index, choice_idx AS picked FROM (
      SELECT *, row_number() OVER (PARTITION BY model, task, item_id ORDER BY logprob DESC, choice_idx) AS rn
      FROM {src('choices')}) AS x WHERE rn = 1"""
BEST = f"""SELECT model, task, item_id, any_value(gold_index) AS gold_index,
      first(choice_idx ORDER BY logprob DESC, choice_idx) FILTER (logprob IS NOT NULL) AS picked
      FROM {src('many_choices')} GROUP BY model, task, item_id"""
add(
    "score_loglikelihood_choice",
    f"""
    SELECT form, model, task, item_id, picked, CASE WHEN picked = gold_index THEN 1.0::DOUBLE ELSE 0 END AS value
    FROM (SELECT 'four' AS form, model, task, item_id, gold_index, picked FROM ({PICKED}) AS p
          UNION ALL SELECT f.form, model, task, item_id, gold_index, picked
          FROM ({BEST}) AS b, (SELECT unnest(['counted', 'sorted']) AS form) AS f) AS x
    """,
)
MAD = f"""
    WITH s AS (SELECT item_id, gold, {last_match('text', VECTOR)} AS stated FROM {src('severity')}),
    p AS ({base_scores('s', 'stated')}), g AS ({base_scores('s', 'gold')}),
    m AS (SELECT s.item_id, CASE WHEN stated IS NULL THEN 10.0::DOUBLE
                 WHEN p.score IS NULL OR g.score IS NULL THEN CASE WHEN stated = gold THEN 0 ELSE 10.0::DOUBLE END
                 ELSE abs(p.score - g.score) END AS mad
          FROM s JOIN p USING (item_id) JOIN g USING (item_id))"""
add("score_severity_mad", f"{MAD} SELECT item_id, round(mad, 6) AS mad FROM m")
add(
    "score_severity_similarity",
    f"{MAD} SELECT item_id, round(greatest(0, least(1, 1 - mad / 10)), 6) AS similarity FROM m",
)
add(
    "score_technique_f1",
    f"""
    SELECT item_id, CASE WHEN text IS NULL THEN 0.0::DOUBLE WHEN len(p) = 0 AND len(g) = 0 THEN 1
                         WHEN k = 0 THEN 0
                         ELSE 2 * ((k / len(p)) * (k / len(g))) / ((k / len(p)) + (k / len(g))) END AS value
    FROM (SELECT *, len(list_intersect(p, g)) AS k
          FROM (SELECT item_id, text, list_distinct({FOUND}) AS p, list_distinct({GOLDEN}) AS g
                FROM {src('techniques')}) AS a) AS b
    """,
)
MULTI = f"""
    {LETTERED},
    wide AS (SELECT model, task, item_id, {EM} AS em, {PEM} AS pem, {ACC} AS acc FROM lettered),
    samples AS (SELECT model, task, item_id, 'em' AS metric, 'exact_match' AS scorer, em AS value FROM wide
                UNION ALL SELECT model, task, item_id, 'pem', 'prefix_match', pem FROM wide
                UNION ALL SELECT model, task, item_id, 'acc', 'mcq_regex', acc FROM wide WHERE length(task) % 2 = 1)"""
add("score_multi_metric", f"WITH {MULTI} SELECT model, task, item_id, metric, value FROM samples")
# The response is cut at the first line feed; rows whose label is wrong have no prompt. Every
# prompt counts for each model that was run on its task.
RUN = f"""
    run AS (SELECT * FROM {src('run')}),
    prompts AS (SELECT item_id, task, gold FROM {src('items')} WHERE gold <> '?'),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY model, task, item_id ORDER BY md5(text) NULLS LAST) AS nth FROM run),
    wanted AS (SELECT m.model, p.task, p.item_id, p.gold
               FROM prompts AS p JOIN (SELECT DISTINCT model, task FROM run WHERE model IS NOT NULL) AS m ON m.task = p.task),"""
CUT = RUN + LETTERED.replace(
    f"FROM {src('responses')}",
    f"""FROM (SELECT w.model, w.task, w.item_id, w.gold, {cut('r.text', NL)} AS text
               FROM wanted AS w LEFT JOIN ranked AS r ON r.model = w.model AND r.task = w.task AND r.item_id = w.item_id AND r.nth = 1) AS c""",
)
add(
    "score_responses",
    f"""
    WITH {MULTI.replace(LETTERED, CUT)}
    SELECT model, task, item_id, metric, value, CAST(NULL AS VARCHAR) AS reason FROM samples
    UNION ALL
    SELECT model, task, item_id, NULL, NULL, CASE WHEN task = 'no:such' THEN 'no such task' WHEN NOT known THEN 'no such item'
           WHEN model IS NULL THEN 'no model' ELSE 'repeated response' END
    FROM (SELECT *, EXISTS (SELECT 1 FROM prompts AS p WHERE p.task = r.task AND p.item_id = r.item_id) AS known FROM ranked AS r) AS x
    WHERE NOT known OR model IS NULL OR nth > 1
    """,
)

# Means

add(
    "task_mean",
    f"""
    WITH {MULTI.replace(LETTERED, CUT)}
    SELECT model, task, metric, scorer, round(avg(value), 6) AS value, count(*) AS n
    FROM samples GROUP BY model, task, metric, scorer
    """,
)
SCORES = f"""{MULTI},
    scores AS (SELECT model, task, metric, scorer, avg(value) AS value, stddev_samp(value) / sqrt(count(*)) AS stderr,
                      count(*) AS n FROM samples GROUP BY ALL)"""
add("task_stderr", f"WITH {SCORES} SELECT model, task, metric, round(stderr, 6) AS stderr FROM scores")
add(
    "all_rollup",
    f"""
    WITH {SCORES}
    SELECT model, task, metric, scorer, round(value, 6) AS value, round(stderr, 6) AS stderr, n FROM scores
    UNION ALL
    SELECT model, 'all', metric, scorer, round(avg(value), 6), round(avg(stderr), 6), CAST(sum(n) AS BIGINT)
    FROM scores GROUP BY model, metric, scorer
    """,
)
SUITE_MEANS = f"""{SCORES}, suites AS (
      SELECT DISTINCT source AS task, 'every' AS suite FROM documents
      UNION ALL SELECT DISTINCT source, CASE WHEN length(source) % 2 = 0 THEN 'even' ELSE 'odd' END FROM documents),
    means AS (SELECT model, suite, metric, scorer, avg(value) AS value, count(*) AS n_tasks
              FROM scores JOIN suites USING (task) GROUP BY model, suite, metric, scorer)"""
add(
    "suite_mean",
    f"WITH {SUITE_MEANS} SELECT model, suite, metric, scorer, round(value, 6) AS value, n_tasks FROM means",
)
add(
    "model_delta",
    f"""
    WITH {SUITE_MEANS}
    SELECT m.model, m.suite, m.metric, m.scorer, round(m.value, 6) AS value, round(b.value, 6) AS baseline,
           round(100 * (m.value - b.value), 6) AS delta
    FROM means AS m LEFT JOIN means AS b ON b.model = 'org/m1' AND b.suite = m.suite AND b.metric = m.metric
      AND b.scorer = m.scorer
    """,
)
add(
    "judge_score_rollup",
    f"""
    SELECT model, dimension, round(avg(score), 6) AS value,
           round(stddev_samp(score) / sqrt(count(score)), 6) AS stderr,
           count(score) AS n, count(*) - count(score) AS n_unjudged
    FROM {src('judged')} GROUP BY model, dimension
    """,
)
add(
    "metric_catalogue",
    f"""
    WITH {MULTI}, used AS (
      SELECT scorer, count(*) AS n FROM samples GROUP BY 1
      UNION ALL SELECT 'loglikelihood', count(*) FROM ({PICKED}) AS p)
    SELECT c.scorer, metric, higher_is_better, category, coalesce(n, 0) AS n
    FROM {values([
        ("mcq_regex", "acc", True, "generative"), ("weakness_id", "acc", True, "generative"),
        ("exact_match", "em", True, "generative"), ("prefix_match", "pem", True, "generative"),
        ("technique_f1", "f1", True, "generative"), ("loglikelihood", "acc", True, "logprobs"),
    ], "c(scorer, metric, higher_is_better, category)")}
    LEFT JOIN used USING (scorer)
    """,
)
ACC_SCORES = f"""{LETTERED},
    scores AS (SELECT model, task, avg({ACC}) AS acc, stddev_samp({ACC}) / sqrt(count(*)) AS acc_stderr
               FROM lettered GROUP BY model, task),
    every AS (SELECT * FROM scores UNION ALL SELECT model, 'all', avg(acc), avg(acc_stderr) FROM scores GROUP BY model)"""
KEY = "CASE WHEN task = 'all' THEN task ELSE task || '|0' END"
add(
    "sink_result_payload",
    f"""
    WITH {ACC_SCORES}
    SELECT model, {KEY} AS task, 'acc' AS metric, round(acc, 6) AS value FROM every
    UNION ALL SELECT model, {KEY}, 'acc_stderr', round(acc_stderr, 6) FROM every
    """,
)
add(
    "scan_result_files",
    f"""
    WITH {ACC_SCORES}
    SELECT model AS folder, model, CAST(2 AS BIGINT) AS files, 2 * count(*) AS entries FROM every GROUP BY model
    """,
)
add(
    "sink_sample_details",
    f"WITH {LETTERED} SELECT model, task, item_id, 'acc' AS metric, {ACC} AS value FROM lettered",
)

# Reports

NAMED = f"""
    parsed AS (SELECT json_path, CAST(payload AS JSON) AS j FROM {src('payloads')} WHERE json_valid(payload)),
    named AS (SELECT json_path, j, coalesce(nullif(j->'config_general'->>'model_name', ''),
                nullif(j->'config_general'->'model_config'->>'model_name', ''),
                regexp_replace(json_path, '/[^/]*$', '')) AS model FROM parsed)"""
ENTRIES = f"""{NAMED},
    keyed AS (SELECT json_path, model, j, unnest(json_keys(j->'results')) AS task FROM named),
    entries AS (SELECT json_path, model, task, json_extract(j, '$.results."' || task || '"') AS m
                FROM keyed WHERE json_type(json_extract(j, '$.results."' || task || '"')) = 'OBJECT')"""
LONG = f"""{ENTRIES},
    metrics AS (SELECT *, unnest(json_keys(m)) AS metric FROM entries),
    long AS (SELECT model, task, json_path, metric, json_extract_string(m, '$."' || metric || '"') AS raw FROM metrics)"""
CELLS = f"""{LONG},
    cells AS (SELECT model, task || '_' || metric AS "column", CAST(raw AS DOUBLE) AS value, raw FROM (
      SELECT *, row_number() OVER (PARTITION BY model, task, metric
                                   ORDER BY string_split(json_path, '/')[-1] DESC, json_path DESC) AS rn FROM long) AS x
      WHERE rn = 1)"""
add("resolve_model_name", f"WITH {NAMED} SELECT json_path, model FROM named")
NAMED_RUN = r"regexp_extract(json_path, 'results_([^/]+)\.json$', 1) AS run"
add(
    "flatten_results",
    f"WITH {LONG} SELECT model, task, json_path, {NAMED_RUN}, metric, CAST(raw AS DOUBLE) AS value, raw FROM long",
)
add(
    "drop_stderr",
    f"WITH {LONG} SELECT model, task, json_path, {NAMED_RUN}, metric, CAST(raw AS DOUBLE) AS value FROM long WHERE NOT ends_with(metric, '_stderr')",
)
EVENTS = ("click", "error", "purchase", "signup", "view")
ACC_COLUMNS = ["all_acc"] + [f"t:{e}|0_acc" for e in EVENTS]
REPORT_COLUMNS = ACC_COLUMNS + [f"t:{e}|0_acc_stderr" for e in EVENTS]


def pivot(columns, cell: str = "value", model: str = "model") -> str:
    picked = ", ".join(f"""max({cell}) FILTER ("column" = '{c}') AS "{c}" """ for c in columns)
    return f"SELECT {model} AS model, {picked} FROM cells GROUP BY model"


add("pivot_by_model", f"WITH {CELLS} {pivot(REPORT_COLUMNS)}")
add(
    "results_long_table",
    f"""
    WITH {ENTRIES} SELECT model, task, json_path, m->>'acc' AS acc, m->>'acc_stderr' AS acc_stderr FROM entries
    """,
)
add("trim_model_prefix", f"WITH {ENTRIES} SELECT json_path, task, model FROM entries")
GRID = f"""{CELLS}, names AS (SELECT DISTINCT "column" FROM cells), models AS (SELECT DISTINCT model FROM cells),
    grid AS (SELECT model, "column" FROM models, names)"""
add(
    "split_by_metric",
    f"""
    WITH {GRID}
    SELECT model, CASE WHEN ends_with("column", '_stderr') THEN 'stderr' ELSE 'acc' END AS metric, "column", value
    FROM grid LEFT JOIN cells USING (model, "column")
    """,
)
TOLD_LATE = "'2025-02-01T00-00-00.000000'"
TOLD_EARLY = "'2025-01-31T23-59-59.999999'"
add(
    "collect_report",
    f"""
    WITH {ACC_SCORES},
    late AS (SELECT replace(model, 'org/', '') AS model, {KEY} AS task, acc, acc_stderr FROM every),
    cells AS (SELECT model, task || '_acc' AS "column", acc AS value FROM late
              UNION ALL SELECT model, task || '_acc_stderr', acc_stderr FROM late),
    runs AS (SELECT model, task, {TOLD_LATE} AS json_path, acc, acc_stderr FROM late
             UNION ALL SELECT model, task, {TOLD_EARLY}, acc / 2, acc_stderr FROM late)
    SELECT part, model, "column", round(value, 6) AS value, CAST(NULL AS VARCHAR) AS task, CAST(NULL AS VARCHAR) AS json_path
    FROM cells, (SELECT unnest(['whole', 'split']) AS part) AS p
    UNION ALL SELECT 'plain', model, "column", round(value, 6), NULL, NULL FROM cells WHERE NOT ends_with("column", '_stderr')
    UNION ALL SELECT 'long', model, 'acc', round(acc, 6), task, json_path FROM runs
    UNION ALL SELECT 'long', model, 'acc_stderr', round(acc_stderr, 6), task, json_path FROM runs
    """,
)
add(
    "sink_csv",
    f"WITH {CELLS} {pivot(['all_acc', 't:click|0_acc'], 'raw')}",
)
add(
    "sink_csv_per_metric",
    f"""
    WITH {GRID}
    SELECT model, "column", raw AS cell,
           CASE WHEN ends_with("column", '_stderr') THEN 'stderr' ELSE 'acc' END AS metric
    FROM grid LEFT JOIN cells USING (model, "column")
    """,
)
SOURCES = [f"src{i}" for i in range(20)]
add(
    "accuracy_report",
    f"""
    WITH {LETTERED}, cells AS (SELECT model, task AS "column", round(avg({ACC}), 6) AS value
                               FROM lettered GROUP BY model, task)
    {pivot(SOURCES)}
    """,
)

# Conversations

add(
    "inject_system_turn",
    f"""
    WITH c AS (SELECT * FROM {src('chat')})
    SELECT conv_id, turn, role, text FROM c
    UNION ALL
    SELECT DISTINCT conv_id, CAST(-1 AS BIGINT), 'system', {lit(SYSTEM)} FROM c AS a
    WHERE NOT EXISTS (SELECT 1 FROM c AS b WHERE b.conv_id = a.conv_id AND b.role = 'system')
    """,
)
TOLD = f"string_agg(role || ': ' || coalesce(text, '-'), {NL}"
add(
    "history_at_turn",
    f"""
    SELECT conv_id, turn, history FROM (
      SELECT conv_id, turn, role, {TOLD}) OVER (PARTITION BY conv_id ORDER BY turn
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS history FROM conversations) AS x
    WHERE role = 'user'
    """,
)
add(
    "long_histories",
    f"""
    SELECT conv_id, turn, CAST(turn + 1 AS INTEGER) AS n, history FROM (
      SELECT conv_id, turn, role, {TOLD}) OVER (PARTITION BY conv_id ORDER BY turn
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS history FROM {src('long_chat')}) AS x
    WHERE role = 'user'
    """,
)
add(
    "history_blocks",
    f"SELECT conv_id, turn // 3 AS block, {TOLD} ORDER BY turn) AS history FROM conversations GROUP BY 1, 2",
)
add(
    "single_turn_prompts",
    f"""
    SELECT conv_id, turn, 'system: ' || {lit(SYSTEM)} || {NL} || 'user: ' || text AS messages
    FROM conversations WHERE role = 'user'
    """,
)
add(
    "prompt_completion_pairs",
    f"""
    SELECT conv_id, turn, text AS prompt, {strip('next_text')} AS completion FROM (
      SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM {src('chat')}
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) AS x
    WHERE role = 'user' AND next_role = 'assistant' AND next_text IS NOT NULL
    """,
)
add(
    "drop_unanswered_turns",
    f"""
    SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, role, text
    FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM {src('chat')}
          WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) AS x
    WHERE NOT (role = 'user' AND (next_role IS DISTINCT FROM 'assistant' OR next_text IS NULL))
      AND NOT (role = 'assistant' AND text IS NULL)
    """,
)
add(
    "skip_blank_turns",
    f"""
    SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN {strip('text')} ELSE text END AS text
    FROM {src('chat')} WHERE role <> 'user' OR {strip('text')} <> ''
    """,
)
add(
    "truncate_at_sentinel",
    f"""
    SELECT conv_id, turn, role, text FROM (
      SELECT *, max(CASE WHEN role = 'user' AND lower({strip('text')}) IN ('quit', 'exit') THEN 1 ELSE 0 END)
                OVER (PARTITION BY conv_id ORDER BY turn) AS over FROM {src('chat')}) AS x WHERE over = 0
    """,
)
add(
    "chat_history",
    f"""
    WITH c AS (SELECT *, min(CASE WHEN role = 'user' AND lower({strip('text')}) IN ('quit', 'exit') THEN turn END)
                         OVER (PARTITION BY conv_id) AS quit FROM {src('chat')}),
    said AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN {strip('text')} ELSE text END AS text FROM c
             WHERE (quit IS NULL OR turn < quit) AND NOT (role = 'user' AND {strip('text')} = '')
               AND NOT (role = 'assistant' AND text IS NULL)),
    told AS (SELECT * FROM said UNION ALL
             SELECT conv_id, -1, 'system', {lit(SYSTEM)} FROM c GROUP BY conv_id
             HAVING count(*) FILTER (role = 'system') = 0),
    kept AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM told)
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, role, text FROM kept
    WHERE role <> 'user' OR next_role IS NOT DISTINCT FROM 'assistant'
    """,
)
add(
    "reject_empty_replies",
    f"""
    SELECT conv_id, turn, role, text, CASE WHEN text IS NULL THEN 'empty reply' END AS reason
    FROM {src('chat')} WHERE role = 'assistant'
    """,
)
add(
    "reply_failure_rates",
    f"SELECT model, count(*) AS requests, count(*) - count(text) AS failures FROM {src('responses')} GROUP BY model",
)

# Corpus

# Markup in the syntax of the other engine: no possessive quantifiers, no references back.
_S = r"[\x20\x09-\x0D]"
_IN = r"""(?:[^>"']|"[^"]*"|''[^'']*''|["''])*(?:>|\z)""".replace("[^>\"']", "[^>\"'']")
_REST = rf"(?:[\x20\x09-\x0D/]{_IN}|>|\z)"
_RAW = "script style noscript template title textarea svg iframe select".split()
_UNREAD = "|".join(
    [r"<!--(?:.*?-->|.*\z)"]
    + [rf"<{e}{_REST}(?:.*?</{e}(?:[\x20\x09-\x0D/][^>]*)?(?:>|\z)|.*\z)" for e in _RAW]
    + [r"<[!?][^>]*(?:>|\z)", r"</[^a-z>][^>]*(?:>|\z)"]
)
_BREAKING = (
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary "
    "table tbody td tfoot th thead tr ul"
).replace(" ", "|")
_APART = (
    "ad ads advert advertisement banner breadcrumb breadcrumbs cookie cookies footer menu nav navbar navigation promo "
    "share sidebar social sponsor sponsored widget"
).replace(" ", "|")
_NAMED = rf"""(?:"(?:[^"]*[^A-Za-z0-9"])?(?:{_APART})(?:[^A-Za-z0-9"][^"]*)?"|''(?:[^'']*[^A-Za-z0-9''])?(?:{_APART})(?:[^A-Za-z0-9''][^'']*)?'')"""
_SUBSTITUTIONS = [
    (r"[\x01-\x05]", " "),
    (f"(?is){_UNREAD}", " "),
    (f"(?i)<a{_REST}", "\x01"),
    (f"(?i)</a{_REST}", "\x02"),
    (f"(?i)<(?:aside|footer|form|menu|nav){_REST}", "\x04"),
    (
        f"(?i)<(?:div|header|ol|p|section|table|ul){_S}(?:[^>]*?{_S})?(?:class|id|role){_S}*={_S}*{_NAMED}{_IN}",
        "\x04",
    ),
    (f"(?i)<(?:{_BREAKING}){_REST}", "\x03"),
    (f"(?i)</(?:{_BREAKING}){_REST}", "\x05"),
    (rf"(?i)</?[a-z][^\x20\x09-\x0D/>]*{_REST}", ""),
]
_JOINED = [
    (r"[\x20\x09-\x0D\x{0085}\x{00A0}]+", " "),
    (r"\x04 ?\x05", "\x03"),
    (r"[\x03\x05][\x03\x05 ]*", "\x03"),
    (r" ?\x03?\x04[\x03\x04 ]*", "\x04"),
]


def _chr(x: str) -> str:
    return "''" if x == "" else " || ".join(f"chr({ord(c)})" for c in x)


def _substituted(column: str, pairs) -> str:
    for pattern, by in pairs:
        column = f"regexp_replace({column}, '{pattern}', {_chr(by)}, 'g')"
    return column


_NAMES = ", ".join(f"'{n}': chr({c})" for n, c in [*name2codepoint.items(), ("apos", 39)])
_COUNT = "len(string_split({0}, ' '))"
add(
    "page_text",
    rf"""
    WITH marked AS (SELECT page_id, string_split({_substituted("coalesce(html, '')", _SUBSTITUTIONS)}, '&') AS parts FROM pages),
    part AS (SELECT page_id, i, parts[i] AS p, regexp_extract(parts[i], '^#([0-9]{{1,9}});', 1) AS d,
             regexp_extract(parts[i], '^#[xX]([0-9A-Fa-f]{{1,8}});', 1) AS x, regexp_extract(parts[i], '^([A-Za-z][A-Za-z0-9]*);', 1) AS n
             FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM marked)),
    coded AS (SELECT *, CASE WHEN d <> '' THEN CAST(d AS BIGINT) WHEN x <> '' THEN CAST('0x' || x AS BIGINT) END AS c,
              MAP {{{_NAMES}}}[n] AS named, substr(p, strpos(p, ';') + 1) AS rest FROM part),
    decoded AS (SELECT page_id, string_agg(CASE WHEN i = 1 THEN p
                WHEN c = 0 OR c > 1114111 OR c BETWEEN 55296 AND 57343 THEN chr(65533) || rest
                WHEN c < 32 THEN ' ' || rest WHEN c IS NOT NULL THEN chr(CAST(c AS INT)) || rest
                WHEN named IS NOT NULL THEN named || rest ELSE '&' || p END, '' ORDER BY i) AS t FROM coded GROUP BY page_id),
    joined AS (SELECT page_id, regexp_extract_all({_substituted("t", _JOINED)}, '[]?[^]+') AS pieces FROM decoded),
    piece AS (SELECT page_id, i, starts_with(pieces[i], chr(4)) AS apart,
              trim(regexp_replace(regexp_replace(pieces[i], '[-]', '', 'g'), ' +', ' ', 'g')) AS t,
              trim(regexp_replace(regexp_replace(regexp_replace(pieces[i], '\A[^]*|[^]*(?:|\z)', ' ', 'g'),
                   '[-]', '', 'g'), ' +', ' ', 'g')) AS u
              FROM (SELECT page_id, pieces, unnest(range(1, len(pieces) + 1)) AS i FROM joined)),
    sized AS (SELECT page_id, i, t, apart, {_COUNT.format('t')} AS w,
              {_COUNT.format('t')} - CASE WHEN u = '' THEN 0 ELSE {_COUNT.format('u')} END AS l FROM piece WHERE t <> ''),
    judged AS (SELECT *, NOT apart AND 3 * l <= w AS plain, NOT apart AND 3 * l <= w AND w >= 15 AS long FROM sized),
    beside AS (SELECT *, plain AND (long OR coalesce(lag(long) OVER o, FALSE) OR coalesce(lead(long) OVER o, FALSE)) AS kept
               FROM judged WINDOW o AS (PARTITION BY page_id ORDER BY i))
    SELECT pages.page_id, coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (kept), '') AS text, count(i) AS n_blocks,
           count(i) FILTER (kept) AS n_kept
    FROM pages LEFT JOIN beside ON beside.page_id = pages.page_id GROUP BY pages.page_id
    """,
)

_FOLDED = r"lower(trim(regexp_replace(text, '[\x20\x09-\x0D\x{0085}\x{00A0}]+', ' ', 'g')))"
_CLASSED = f"""
    (SELECT doc_id, n_chars, lang, source, text, h, CASE WHEN h IS NOT NULL THEN min(doc_id) OVER (PARTITION BY h) END AS keep_id,
            CASE WHEN h IS NOT NULL THEN count(*) OVER (PARTITION BY h) END AS n
     FROM (SELECT *, md5({_FOLDED}) AS h FROM documents) AS x)"""
add(
    "exact_dedup",
    f"""
    SELECT doc_id, h AS class_hash, keep_id, n AS class_size, h IS NULL OR doc_id = keep_id AS kept FROM {_CLASSED}
    """,
)
add(
    "exact_classes",
    f"SELECT h AS class_hash, min(doc_id) AS keep_id, count(*) AS class_size FROM {_CLASSED} WHERE h IS NOT NULL GROUP BY h",
)
add(
    "dedup_keep_best",
    f"""
    SELECT doc_id, text, lang, source, n_chars
    FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY n_chars DESC NULLS LAST, doc_id) AS r FROM {_CLASSED}) AS x
    WHERE r = 1 OR h IS NULL
    """,
)
_WORDS = r"CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT)"
add(
    "corpus_stats",
    f"""
    SELECT source, lang, CAST(GROUPING_ID(source, lang) AS BIGINT) AS level, count(*) AS documents,
           CAST(sum(CASE WHEN w = 0 THEN 1 ELSE 0 END) AS BIGINT) AS blank, CAST(sum(w) AS BIGINT) AS words,
           CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, min(w) AS fewest, max(w) AS most
    FROM (SELECT *, {_WORDS} AS w FROM documents) AS x GROUP BY CUBE (source, lang)
    """,
)
add(
    "replay_mix",
    """
    SELECT doc_id, source, lang, 'domain' AS origin FROM documents WHERE starts_with(source, 'src1')
    UNION ALL
    SELECT doc_id, source, lang, 'replay' AS origin FROM (
      SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY md5(CAST(doc_id AS VARCHAR))) AS r,
             count(*) OVER (PARTITION BY source, lang) AS n
      FROM documents WHERE NOT coalesce(starts_with(source, 'src1'), FALSE)) AS x
    WHERE r <= (n + 9) // 10
    """,
)
_NOTICES = [
    ("apache-2.0", r"apache{s}license,?{s}version{s}2(?:\.0)?"),
    ("cc-by-nc", r"cc[ -]by-nc(?:-(?:sa|nd))?(?: [0-9]\.[0-9])?"),
    ("cc-by-sa", r"cc[ -]by-sa(?: [0-9]\.[0-9])?"),
    ("cc-by", r"cc[ -]by(?: [0-9]\.[0-9])?"),
    ("cc0", r"cc0|public{s}domain{s}dedication"),
    ("gpl", r"gnu{s}(?:lesser{s}|affero{s})?general{s}public{s}license"),
    ("mit", r"mit{s}license"),
    ("bsd", r"bsd{s}(?:[234]-clause{s})?license"),
    ("mpl-2.0", r"mozilla{s}public{s}license"),
    ("reserved", r"all{s}rights{s}reserved"),
    ("terms", r"terms{s}of{s}(?:service|use)"),
]
_NOTICES = [(i, p.replace("{s}", r"[\x20\x09-\x0D]+")) for i, p in _NOTICES]
_ANY_NOTICE = "|".join(f"(?:{p})" for _, p in _NOTICES)
_WHICH = " ".join(rf"WHEN regexp_full_match(x, '(?i)(?:{p})') THEN '{i}'" for i, p in _NOTICES)
_SCANNED = rf"""
    (SELECT doc_id, source, found, list_filter(found, lambda x, i: list_position(found, x) = i) AS ids FROM (
       SELECT doc_id, source, list_transform(regexp_extract_all(coalesce(text, ''),
              '(?i)(?:\A|[^A-Za-z0-9])({_ANY_NOTICE})(?:\z|[^A-Za-z0-9])', 1), lambda x: CASE {_WHICH} END) AS found
       FROM documents) AS y)"""
add(
    "licence_scan",
    f"SELECT doc_id, array_to_string(ids, ',') AS licences, CAST(len(found) AS BIGINT) AS n_notices FROM {_SCANNED}",
)
add(
    "licences_by_source",
    f"""
    WITH s AS (SELECT doc_id, source, len(found) AS n, CASE WHEN len(ids) = 0 THEN ['none'] ELSE ids END AS ids FROM {_SCANNED}),
    e AS (SELECT source, ids[i] AS licence, i, n FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM s))
    SELECT source, licence, CAST(GROUPING_ID(source, licence) AS BIGINT) AS level,
           CASE WHEN GROUPING_ID(source, licence) = 0 THEN count(*) ELSE count(*) FILTER (i = 1) END AS documents,
           CAST(sum(CASE WHEN i = 1 THEN n ELSE 0 END) AS BIGINT) AS notices
    FROM e GROUP BY ROLLUP (source, licence)
    """,
)
add(
    "seed_categories",
    f"""
    WITH m AS (SELECT DISTINCT doc_id, source, text, coalesce(category, 'none') AS category, coalesce(kind, 'none') AS kind
               FROM documents LEFT JOIN {values(SEEDS, "seeds(prefix, category, kind)")} ON starts_with(source, prefix))
    SELECT category, kind, CAST(GROUPING_ID(category, kind) AS BIGINT) AS level, count(DISTINCT source) AS sources,
           count(*) AS documents, CAST(sum({_WORDS}) AS BIGINT) AS words
    FROM m GROUP BY CUBE (category, kind)
    """,
)
add(
    "validate_conversations",
    f"""
    WITH n AS (SELECT *, lead(turn) OVER w AS nt, lead(role) OVER w AS nr, row_number() OVER w AS rn
               FROM {src('chat')} WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    c AS (SELECT conv_id, count(*) AS n_turns, min(turn) = 0 AND bool_and(nt IS NULL OR nt = turn + 1) AS contiguous,
          bool_and(coalesce(role IN ('system', 'user', 'assistant'), FALSE)) AS roles_known,
          bool_and(coalesce(role <> 'system' OR turn = 0, FALSE)) AS system_first,
          bool_and(coalesce(nt IS NULL OR CASE WHEN role = 'user' THEN nr = 'assistant' ELSE nr = 'user' END, FALSE))
            AND bool_and(rn > 1 OR coalesce(role IN ('system', 'user'), FALSE)) AS alternates,
          bool_and(nt IS NOT NULL OR coalesce(role = 'assistant', FALSE)) AS answered,
          bool_and(coalesce({strip('text')} <> '', FALSE)) AS no_blank
          FROM n GROUP BY conv_id)
    SELECT *, contiguous AND roles_known AND system_first AND alternates AND answered AND no_blank AS valid FROM c
    """,
)

_PHRASES = [(" ".join(re.findall("[a-z0-9]+", p.lower())), len(re.findall("[a-z0-9]+", p.lower())), w) for p, w in PHRASES]
add(
    "domain_filter_lexicon",
    rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{Nd}}]+') AS w FROM documents),
    p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
    x AS (SELECT * FROM {values(_PHRASES, "x(phrase, n, weight)")}),
    q AS (SELECT doc_id, i, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM p, (SELECT DISTINCT n FROM x) AS y
          WHERE w[i] IN (SELECT string_split(phrase, ' ')[1] FROM x) AND i + n - 1 <= len(w)),
    m AS (SELECT doc_id, i, max(n) AS n, max_by(weight, n) AS weight FROM q JOIN x USING (phrase) GROUP BY doc_id, i),
    l AS (SELECT doc_id, list(struct_pack(free := i + n, at := i, n := 1, weight := weight) ORDER BY i) AS ms FROM m GROUP BY doc_id),
    g AS (SELECT doc_id, list_reduce(ms, lambda a, x: CASE WHEN x.at < a.free THEN a ELSE
            struct_pack(free := x.free, at := x.at, n := a.n + 1, weight := a.weight + x.weight) END) AS s FROM l)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(s.n, 0) AS BIGINT) AS n_phrases,
           CAST(coalesce(s.weight, 0) AS BIGINT) AS weight, len(w) > 0 AND 1000 * coalesce(s.weight, 0) >= 90 * len(w) AS in_domain
    FROM d LEFT JOIN g ON g.doc_id = d.doc_id
    """,
)

#: Queries that SQL can't express: a trained model, tested on held-out rows.
WITHOUT_SQL = {"domain_filter_model"}

# Extension

add(
    "register_scorer",
    f"""
    SELECT model, task, 'mentions' AS metric, max(CASE WHEN contains(text, gold) THEN 1.0::DOUBLE ELSE 0 END) AS value,
           count(*) AS n FROM {src('responses')} GROUP BY model, task
    """,
)
add(
    "register_formatter",
    accepted("upper(subject) || '?' || question", src("items"), STRICT_INDEX, LETTER, required=["question", "gold"]),
)
