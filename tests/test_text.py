import random
import re

from conftest import column
from pyspark.sql import functions as F

from scoreloom.functions import text as T


def apply(spark, fn, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return column(df.select("i", fn(F.col("t")).alias("x")).orderBy("i"), "x")


def test_strip_is_unicode(spark):
    every = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    got = apply(spark, T.strip, [c + "x" + c for c in every])
    assert got == [(c + "x" + c).strip() for c in every]


def test_lines(spark):
    rng = random.Random(5)
    every = [chr(c) for c in range(0x3100) if chr(c).isspace() or c % 97 == 0]
    texts = ["".join(rng.choices([*every, "ab"], k=rng.randint(0, 40))) for _ in range(3000)]
    want = [[x.strip() for x in t.splitlines() if x.strip()] for t in texts]
    assert apply(spark, T.nonblank_lines, texts) == want


def test_choice_letter_cases(spark):
    cases = {
        "A firewall is best: B": "A",
        "x_A": "A",
        "Because": "B",
        "B" + "\n..." * 5: "B",
        "éA": "A",
        "A or B" + "\n..." * 5: None,
        "**C**": "C",
        "x_A**": "A",
        "": None,
        "none": None,
        "D) yes\nB": "B",
        "C\n\n  \n": "C",
        "AB\nA_\nxx_B\n...": "B",
    }
    assert apply(spark, T.extract_choice_letter, list(cases)) == list(cases.values())
    assert apply(spark, T.extract_choice_letter, [None]) == [None]


def restated(text):
    """The rule in a few lines of Python, for comparison."""
    for line in [x.strip() for x in text.splitlines() if x.strip()][::-1][:5]:
        line = line.replace("**", " ")
        alone = re.search(r"(?<!\w)[ABCD](?!\w)", line)
        if alone:
            return alone.group()
        if re.search(r"_[ABCD]\Z", line):
            return line[-1]
    capitals = set(re.findall("[ABCD]", text))
    return capitals.pop() if len(capitals) == 1 else None


def test_choice_letter_on_random_texts(spark):
    rng = random.Random(7)
    alphabet = list("ABCDab_1 .:)*(") + ["**", "\n", "\r\n", " ", "\x1c", "\x85", " "]
    alphabet += ["é", "é", "́", "²", "Ⅳ", "一", "\U0001f600", "\U0001d400", "\t"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(8000)]
    assert apply(spark, T.extract_choice_letter, texts) == [restated(t) for t in texts]


def test_weakness_id(spark):
    texts = ["CWE-79, rather CWE-89", "cwe-1", "", "CWE-٣x"]
    assert apply(spark, T.extract_weakness_id, texts) == ["CWE-89", "cwe-1", "", "CWE-٣"]
    assert apply(spark, T.find_weakness_id, texts) == ["CWE-89", None, None, "CWE-٣"]


def test_severity_vector(spark):
    bare = "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"
    texts = [f"a {bare} b CVSS:3.0/{bare}.", f"CVSS:2.0/{bare}", "AV:N/AC:L", f"{bare}igh"]
    assert apply(spark, T.extract_severity_vector, texts) == [
        f"CVSS:3.0/{bare}", bare, "AV:N/AC:L", f"{bare}igh",
    ]


def test_techniques(spark):
    assert apply(spark, T.extract_techniques, ["AT12345 T1059.001 T1059", "none"]) == [
        ["T1234", "T1059"], [],
    ]
    lists = ["T12345, x, T1003.002", " \n", "t1003, T1059 (x),,T1059", ""]
    assert apply(spark, T.parse_technique_list, lists) == [
        ["T12345", "T1003"], [], ["T1059 (x)", "T1059"], [],
    ]


def test_stops(spark):
    df = spark.createDataFrame(
        [("a\nb", ["\n"]), ("a. b\n", ["\n", ". "]), ("ab", None), ("ab", ["", "b"]), (None, ["x"])],
        "t string, s array<string>",
    )
    assert column(df.select(T.cut_at_stops(F.col("t"), F.col("s")).alias("x")), "x") == [
        "a", "a", "ab", "a", None,
    ]
    assert apply(spark, lambda t: T.cut_at_stops(t, ["\n", "b"]), ["abc\n", "x"]) == ["a", "x"]
    assert apply(spark, lambda t: T.cut_at_stops(t, None), ["abc\n"]) == ["abc\n"]


def test_first_response(spark):
    df = spark.createDataFrame([(["x", "y"],), ([],), (None,)], "t array<string>")
    assert column(df.select(T.first_response(F.col("t")).alias("x")), "x") == ["x", None, None]
