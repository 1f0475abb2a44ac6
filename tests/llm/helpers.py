"""Brute-force versions of the operators, on small tables."""

import re
import zlib

LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def word_list(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))


def crc(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


class Union:
    def __init__(self, n):
        self.parent = list(range(n))

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def small_docs(spark, rows=120):
    """The first documents of the smallest table, as a frame of several partitions."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(rows).repartition(3, "doc_id").cache()


def every_shingle(line):
    return [line[i : i + 12] for i in range(max(1, len(line) - 11))]


def near_lines(lines, shingles, threshold):
    """Components of distinct lines by exact Jaccard similarity of their shingles."""
    sets, union = [frozenset(shingles(x)) for x in lines], Union(len(lines))
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and common / (len(a) + len(sets[j]) - common) >= threshold:
                union.join(i, j)
    return [union.find(i) for i in range(len(lines))]


def repeats(docs, length=100):
    """(removed bytes, runs, kept bytes) of every (doc_id, text), taken by doc_id."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(data[p : p + length])
        runs = sum(bool(g) and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[doc_id] = sum(gone), runs, bytes(b for b, g in zip(data, gone) if not g)
    return out
