"""URL rules by a bit-parallel wildcard automaton.

All glob rules are one Shift-And machine: each position of each rule is a bit of a few 64-bit words, a character's mask tells which
positions it can enter, and one shift advances every rule at once; wildcards are positions that a second mask lets stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rows, chunks, text_bytes, with_fields


@dataclass(frozen=True)
class UrlRule:
    """A glob over canonical URLs (`.host/path`): `*` is any run without `/`, `**` any run, `?` one character but `/`. Of the rules
    that match, the one of the highest rank decides, the first of equals. name is None for rules that aren't reported."""

    glob: str
    verdict: str
    name: str | None = None
    rank: int = 0


def host_rule(host: str, path: str, verdict: str) -> UrlRule:
    """Fits the host and all its subdomains where the URL's path starts with path; the longest wins over others, and over globs."""
    return UrlRule(f"*.{host}{path}**", verdict, host + path, len(host + path))


#: The rules of the query contract, and globs for hosts that only exist to be linked to.
BASE_RULES = [host_rule("com", "/en/", "block"), host_rule("example.com", "/en/7", "allow"), host_rule("net", "/de/", "allow"), host_rule("example.net", "/de/8", "block"), host_rule("org", "/es/", "block")]

#: Words that mark such hosts where they stand between dots or hyphens: betting, adult content, advertising and tracking, quack
#: remedies, loans, link and download farms.
SPAM_WORDS = (
    "casino casinos poker slots bets betting jackpot lottery roulette bingo gambling adult porn xxx sex nude escort escorts webcams "
    "ad ads adserver adservice banners popups popunder tracker trackers tracking pixel clicks affiliate affiliates "
    "pills viagra cialis steroids replica payday loans bitcoin-doubler get-rich spam spam-farm link-farm linkfarm warez keygen clickbait free-gifts free-money"
).split()
SPAM_GLOBS = [UrlRule(f"*{before}{w}{after}**", "block") for w in SPAM_WORDS for before in ".-" for after in ".-"]


class Automaton:
    """The rules as masks of W words: enter[c] has the positions that character c can enter, stay[c] those it leaves active, open the
    positions reached without a character from the one before (wildcards match nothing too)."""

    def __init__(self, rules: list[UrlRule]) -> None:
        self.rules = rules
        tokens: list[list[str]] = [[] for _ in rules]
        for out, rule in zip(tokens, rules, strict=True):
            i = 0
            while i < len(glob := rule.glob):
                out.append("**" if glob.startswith("**", i) else glob[i])
                i += len(out[-1])
        # A rule's bytes; a wildcard is a bit of its own behind the byte (or start) it follows.
        flat: list[list[str | int]] = [[x for t in out for x in ([t] if t in ("*", "**", "?") else t.encode())] for out in tokens]
        total = sum(len(f) + 1 for f in flat)
        self.width = max(1, -(-total // 64))
        self.enter, self.stay = np.zeros((256, self.width), np.uint64), np.zeros((256, self.width), np.uint64)
        self.open, self.start = np.zeros(self.width, np.uint64), np.zeros(self.width, np.uint64)
        self.final: list[int] = []
        self.runs = 0
        at = 0
        anything, segment = range(256), [c for c in range(256) if c != 0x2F]
        for f in flat:
            self.put(self.start, at)
            run = 0
            for x in f:
                at += 1
                run = run + 1 if x in ("*", "**") else 0
                self.runs = max(self.runs, run)
                if x in ("*", "**"):
                    self.put(self.open, at)
                    for c in anything if x == "**" else segment:
                        self.put(self.stay[c], at)
                else:
                    for c in segment if x == "?" else [x]:
                        self.put(self.enter[c], at)
            self.final.append(at)
            at += 1

    @staticmethod
    def put(mask: np.ndarray, bit: int) -> None:
        mask[bit // 64] |= np.uint64(1 << bit % 64)

    @staticmethod
    def shifted(state: np.ndarray) -> np.ndarray:
        """All words of each row one bit up; the top bit of a word goes to the next."""
        out = state << np.uint64(1)
        out[:, 1:] |= state[:, :-1] >> np.uint64(63)
        return out

    def closed(self, state: np.ndarray) -> np.ndarray:
        """With the wildcards behind active positions; as often as wildcards follow one another."""
        for _ in range(self.runs):
            state = state | self.shifted(state) & self.open
        return state

    def matches(self, column: pa.Array) -> np.ndarray:
        """(strings, rules): which rules match each string whole."""
        data, offsets = text_bytes(column)
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        at, size = offsets[:-1][order], size[order]
        state = self.closed(np.broadcast_to(self.start, (len(order), self.width)).copy())
        live = len(order)
        for i in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -i, "left"))  # the strings that are longer than i
            c = data[at[:live] + i]
            now = state[:live]
            state[:live] = self.closed(self.shifted(now) & self.enter[c] | now & self.stay[c])
        out = np.empty((len(order), len(self.rules)), bool)
        out[order] = np.stack([state[:, f // 64] >> np.uint64(f % 64) & np.uint64(1) for f in self.final], axis=1).astype(bool) if self.final else False
        return out


def host_of(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, rules: list[UrlRule] | None = None, default: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule (the deciding rule's name or null), verdict.

    Each row by itself, whatever the URL's length; no shuffle. Of rules of one rank the first decides. A null or empty URL, or one
    without ://, has empty host and path; it gets the verdict of what matches the canonical form `.`, so mostly the default. Repeated
    rows are repeated, an empty table gives no rows. All columns of pages stay, whatever their names, but for those named like an
    added one (in any case), which the result's replace.
    """
    rules = [*BASE_RULES, *SPAM_GLOBS] if rules is None else rules
    plain = Rows(pages)
    at = F.col(plain.column(url))
    rows = plain.df.withColumns({"host": host_of(at), "path": path_of(at)}).withColumn("canonical", F.concat(F.lit("."), "host", "path"))
    order = sorted(range(len(rules)), key=lambda i: (-rules[i].rank, i))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(rules)
        for batch in batches:
            for part, texts in chunks(batch, "canonical", 1 << 18):
                hit = machine.matches(texts)[:, order]
                best = np.where(hit.any(axis=1), hit.argmax(axis=1), -1) if len(rules) else np.full(len(part), -1)
                chosen = [rules[order[b]] if b >= 0 else None for b in best.tolist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([r and r.name for r in chosen], pa.string()), pa.array([r.verdict if r else default for r in chosen], pa.string())], names=[*part.schema.names, "rule", "verdict"])

    out = rows.mapInArrow(run, with_fields(rows, "rule string, verdict string"))
    return plain.back(out, {c: c for c in ("host", "path", "rule", "verdict")})
