"""URL filters: glob rules as one bit-parallel automaton over canonical URLs.

A canonical URL is its host (ASCII letters lower-cased) followed by its path, in UTF-8.
In a glob ``*`` stands for any bytes but ``/`` and ``**`` for any bytes, empty included;
everything else stands for itself. All globs are laid one after the other into rows of
64-bit words, a bit for each literal byte plus one for "nothing read yet". A byte moves
each set bit up where the rule has that byte next (Shift-And) and keeps it where the rule
may loop there (a wildcard), for all rules at once and for a batch of URLs at once. What
has reached its rule's last bit at the URL's end has matched.

Rules are a parameter, no table: the masks (256 rows of bits) are made once and sent to
the tasks, ``(literal bytes + 1) * 512 / 8`` bytes a rule. Pages are not shuffled.

Defined cases: a null URL or one without ``://`` has an empty host and path and matches
no rule with a host; ports and user names belong to the host. Each row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rows

#: Host-and-path rules of the contract: fixed values.
SITE_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
#: Words in a host, and the start of a path, that block what no site rule decides.
BLOCKED_HOSTS = ("casino", "free-bets", "porn", "viagra")
BLOCKED_PATHS = ("wp-login",)
DECISIONS = "host string, path string, rule string, verdict string"


@dataclass(frozen=True)
class Rule:
    glob: str
    verdict: str
    name: str | None = None  # reported; None for a rule that only sets the verdict
    rank: int = 0  # the greatest rank that matches decides, the first rule among equals


def site_rules(sites=SITE_RULES) -> list[Rule]:
    """Each site rule as two globs, for its host and for the hosts below it; longest wins."""
    return [
        Rule(f"{below}{host}{path}**", verdict, host + path, len(host + path) + 1)
        for host, path, verdict in sites
        for below in ("", "*.")
    ]


def glob_rules(hosts=BLOCKED_HOSTS, paths=BLOCKED_PATHS) -> list[Rule]:
    """Globs without a name: a word anywhere in the host, a path segment's start."""
    in_host = [Rule(f"*{word}*{rest}", "block") for word in hosts for rest in ("", "/**")]
    return in_host + [Rule(f"**/{word}**", "block") for word in paths]


@dataclass
class Automaton:
    step: np.ndarray  # [byte, word]: bits that a byte may enter
    loop: np.ndarray  # [byte, word]: bits that stay on a byte
    start: np.ndarray
    last_word: np.ndarray  # where the last bit of each rule stands
    last_bit: np.ndarray
    rules: list[Rule]


def automaton(rules: list[Rule]) -> Automaton:
    """The bits of all rules: bit 0 of a rule is set at the start of a URL."""
    parts = []
    for rule in rules:
        literals, loops = [], ["none"]
        pieces = rule.glob.encode()
        i = 0
        while i < len(pieces):
            if pieces[i : i + 1] == b"*":
                deep = pieces[i : i + 2] == b"**"
                loops[-1] = "all" if deep or loops[-1] == "all" else "segment"
                i += 1 + deep
            else:
                literals.append(pieces[i])
                loops.append("none")
                i += 1
        parts.append((literals, loops))
    n_words = sum(len(loops) for _, loops in parts) // 64 + 1
    step, loop = (np.zeros((256, n_words), np.uint64) for _ in range(2))
    start, last = np.zeros(n_words, np.uint64), []
    at = 0
    for literals, loops in parts:
        start[at >> 6] |= np.uint64(1 << (at & 63))
        for i, kind in enumerate(loops):
            word, bit = (at + i) >> 6, np.uint64(1 << ((at + i) & 63))
            if i:
                step[literals[i - 1], word] |= bit
            if kind != "none":
                loop[:, word] |= bit
                if kind == "segment":
                    loop[ord("/"), word] &= ~bit
        at += len(loops)
        last.append(at - 1)
    ends = np.array(last, np.int64)
    return Automaton(step, loop, start, ends >> 6, (ends & 63).astype(np.uint64), rules)


def matches(machine: Automaton, urls: list[bytes]) -> np.ndarray:
    """[url, rule]: whether the rule matches the whole URL."""
    lengths = np.array([len(u) for u in urls], np.int64)
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths = lengths[order]
    starts = np.cumsum(sorted_lengths) - sorted_lengths
    text = np.frombuffer(b"".join(urls[i] for i in order), np.uint8)
    states = np.tile(machine.start, (len(urls), 1))
    one, top = np.uint64(1), np.uint64(63)
    for place in range(int(sorted_lengths[0]) if len(urls) else 0):
        live = int(np.searchsorted(-sorted_lengths, -place, side="left"))  # longer than place
        byte = text[starts[:live] + place]
        state = states[:live]
        moved = state << one
        moved[:, 1:] |= state[:, :-1] >> top
        states[:live] = (moved & machine.step[byte]) | (state & machine.loop[byte])
    ended = (states[:, machine.last_word] >> machine.last_bit) & one
    out = np.empty((len(urls), len(machine.rules)), bool)
    out[order] = ended == 1
    return out


def judge(
    pages: DataFrame,
    rules: list[Rule] | None = None,
    default: str = "allow",
    url: str = "url",
    keep: list[str] | None = None,
) -> DataFrame:
    """The pages with ``host``, ``path``, the name of the deciding ``rule`` and the ``verdict``."""
    rules = [*site_rules(), *glob_rules()] if rules is None else rules
    machine = automaton(rules)
    ranked = sorted(range(len(rules)), key=lambda i: (-rules[i].rank, i))
    held = pages.sparkSession.sparkContext.broadcast((machine, ranked))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        machine, ranked = held.value
        columns = np.array(ranked, np.int64)
        for batch in batches:
            hosts, paths = batch["host"].to_pylist(), batch["path"].to_pylist()
            found = matches(machine, [(h + p).encode() for h, p in zip(hosts, paths)])
            found = found[:, columns] if len(columns) else np.zeros((len(hosts), 1), bool)
            first, any_ = found.argmax(1), found.any(1)
            best = [machine.rules[ranked[i]] if a else None for i, a in zip(first, any_)]
            yield [
                pa.array(hosts, pa.string()),
                pa.array(paths, pa.string()),
                pa.array([r and r.name for r in best], pa.string()),
                pa.array([r.verdict if r else default for r in best], pa.string()),
            ]

    whole = F.coalesce(F.col(url), F.lit(""))
    after = F.when(
        F.instr(whole, "://") > 0, F.substring(whole, F.instr(whole, "://") + 3, F.length(whole))
    ).otherwise("")
    host = F.regexp_extract(after, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(after, r"\A[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return rows.through_arrow(pages, {"host": lower, "path": path}, work, DECISIONS, keep)
