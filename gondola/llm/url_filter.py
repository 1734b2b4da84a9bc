"""URL filter: rules as a sorted array of 64-bit digests, probed by vectorised binary search.

A rule has a host and a path and fits that host and its subdomains where the url's
path starts with the rule's path; the longest rule (host and path together, then
the longer host) wins.  The rules file, sent to every executor with addFile and
memory-mapped there, holds sorted xxhash64 digests of ``host + path``, offsets and
the strings.  A url's candidates are the suffixes of its host, no longer than the longest host of a rule, joined with the
prefixes of its path of lengths that rules have; a digest found is confirmed by
its full string, so collisions do no harm.  What a url costs is bounded by the rules, not by its length.

Defined results: a null url, and one without ``://``, has an empty host and path and
no rule.  A url without a rule gets the default verdict.  A rule given twice: the
last one holds.  Repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MAGIC = b"URLRULE2"
_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    verdict: str  #: allow or block
    host: str
    path: str


def pack(rules: list[Rule]) -> bytes:
    """The rules file: magic, counts, greatest host length, path lengths, digests, offsets, strings."""
    last = {(r.host + r.path): r for r in rules}
    rows = sorted((xxhash.xxh64_intdigest(k), k, r) for k, r in last.items())
    lengths = sorted({len(r.path) for r in last.values()})
    blobs = [f"{r.verdict[0]}{k}".encode() for _, k, r in rows]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype("<u8")
    head = np.array([len(rows), len(lengths), max((len(r.host) for r in last.values()), default=0)], "<u8")
    return MAGIC + head.tobytes() + np.array(lengths, "<u8").tobytes() + np.array([d for d, _, _ in rows], "<u8").tobytes() + offsets.tobytes() + b"".join(blobs)


class RuleFile:
    """The file, memory-mapped."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        assert bytes(whole[:8]) == MAGIC, "not a rules file"
        n, k, self.longest = (int(x) for x in whole[8:32].view("<u8"))
        at = 32
        self.lengths = whole[at : at + 8 * k].view("<u8").astype(int).tolist()
        at += 8 * k
        self.digests = whole[at : at + 8 * n].view("<u8")
        at += 8 * n
        self.offsets = whole[at : at + 8 * (n + 1)].view("<u8")
        self.strings = whole[at + 8 * (n + 1) :]

    def entry(self, k: int) -> tuple[str, str]:
        raw = bytes(self.strings[int(self.offsets[k]) : int(self.offsets[k + 1])]).decode()
        return ("allow" if raw[0] == "a" else "block"), raw[1:]

    def find(self, keys: list[str]) -> list[str | None]:
        """The verdict of each key that is a rule."""
        digests = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, digests)
        out: list[str | None] = [None] * len(keys)
        inside = np.flatnonzero(at < len(self.digests))
        for i in inside[self.digests[at[inside]] == digests[inside]]:
            k = int(at[i])
            while k < len(self.digests) and self.digests[k] == digests[i]:
                verdict, text = self.entry(k)
                if text == keys[i]:
                    out[i] = verdict
                    break
                k += 1
        return out


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a url."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    stop = min([k for k in map(rest.find, "/?#") if k >= 0], default=len(rest))
    host, tail = rest[:stop], rest[stop:]
    return host.translate(_LOWER), tail[: min([k for k in map(tail.find, "?#") if k >= 0], default=len(tail))]


def suffixes(host: str, longest: int) -> Iterator[str]:
    """A host and its parent domains that have at most `longest` characters."""
    if 0 < len(host) <= longest:
        yield host
    at = max(len(host) - longest - 1, 0)
    while (at := host.find(".", at) + 1) and at < len(host):
        yield host[at:]


def judged(urls: list[str | None], rules: RuleFile, default: str) -> list[tuple[str, str, str | None, str]]:
    """(host, path, rule, verdict) of each url."""
    split = [parts(u) for u in urls]
    keys, owner, ranks = [], [], []
    for i, (host, path) in enumerate(split):
        for domain in suffixes(host, rules.longest):
            for n in rules.lengths:
                if n <= len(path):
                    keys.append(domain + path[:n])
                    owner.append(i)
                    ranks.append((len(domain) + n, len(domain)))
    best: dict[int, tuple] = {}
    for key, i, rank, verdict in zip(keys, owner, ranks, rules.find(keys)):
        if verdict and (i not in best or rank > best[i][0]):
            best[i] = (rank, key, verdict)
    return [(*split[i], *(best[i][1:] if i in best else (None, default))) for i in range(len(urls))]


@cache
def _mapped(name: str) -> RuleFile:
    return RuleFile(SparkFiles.get(name))


def distribute(spark: SparkSession, rules: list[Rule]) -> str:
    """Send the rules file to all executors; returns its name there, which its content decides.

    The driver's copy lies in a folder of its own; executors get theirs from Spark, not from that folder.
    """
    data = pack(rules)
    name = f"url-rules-{xxhash.xxh64_hexdigest(data)}.bin"
    if name not in _sent.setdefault(spark.sparkContext.applicationId, set()):
        path = os.path.join(tempfile.mkdtemp(prefix="gondola-rules-"), name)
        with open(path, "wb") as f:
            f.write(data)
        spark.sparkContext.addFile(path)
        _sent[spark.sparkContext.applicationId].add(name)
    return name


#: Rules files that each application has sent.
_sent: dict[str, set[str]] = {}


def verdicts(spark: SparkSession, url: Column, rules: list[Rule], default: str = "allow") -> Column:
    """struct(host, path, rule, verdict) of a url column."""
    name = distribute(spark, rules)

    @F.arrow_udf("struct<host: string, path: string, rule: string, verdict: string>")
    def judge(urls: pa.Array) -> pa.Array:
        columns = list(zip(*judged(urls.to_pylist(), _mapped(name), default))) or [[]] * 4
        return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names=["host", "path", "rule", "verdict"])

    return judge(url)
