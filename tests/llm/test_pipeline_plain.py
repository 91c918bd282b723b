"""The pipeline's result against a plain version of all its stages."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from linkstream.llm import language, packing, secrets
from linkstream.sources.tables import read_table
from tests.conftest import SF001
from tests.llm.test_operators import brute_links


def plain_redaction(text):
    found = []
    for rank, kind in enumerate(secrets.KINDS):
        for m in re.finditer(secrets.PATTERNS[kind], text):
            group, least = secrets.VALUE_GROUP.get(kind, (0, 0))
            if len(m.group(group)) >= least and (kind != "token" or re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])):
                found.append((m.start(), rank, m.end()))
    spans = []
    for s, r, e in found:
        near = {x for a, x, b in found if s - secrets.REACH < b <= s or e <= a < e + secrets.REACH}
        access, secret = bool(near & {1, 3}), bool(near & {0, 2, 4})
        covered = any(x < 3 and a < e and b > s for a, x, b in found)
        if r < 3 or not covered and {3: secret, 4: access, 5: access and secret}[r]:
            spans.append((s, e))
    out, at = "", 0
    for s, e in sorted(spans):
        if s >= at:
            out += text[at:s] + secrets.MARK
        at = max(at, e)
    return out + text[at:]


def plain_copies(rows):
    """(id, source, text) -> copies of each, by inverting the Poisson distribution at hashed draws."""
    chars = Counter()
    for _, source, text in rows:
        chars[source] += len(text)
    total, roots = sum(chars.values()), sum(math.sqrt(c) for c in chars.values())
    out = {}
    for doc, source, _ in rows:
        rate = round(math.sqrt(chars[source]) / roots * total / chars[source], 12) if chars[source] else 1.0
        parts = max(math.ceil(rate / 32), 1)
        mean, n = rate / parts, 0
        for j in range(1, parts + 1):
            u = (int(hashlib.md5(f"0|{doc}|{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
            p = s = math.exp(-mean)
            k = 0
            while round(s, 12) <= u and k < int(mean + 12 * math.sqrt(mean) + 30) + 1:
                k += 1
                p *= mean / k
                s += p
            n += k
        out[doc] = n
    return out


def test_pipeline_against_a_plain_version(spark):
    from tokenizers import Tokenizer
    docs = {r["doc_id"]: r for r in read_table(spark, SF001, "documents").collect()}
    kept = [d for d, r in sorted(docs.items()) if language.has_letter(r["text"] or "")]
    kept = sorted({g for _, g, _ in brute_links([(d, docs[d]["text"]) for d in kept])})
    clean = [(d, docs[d]["source"], plain_redaction(docs[d]["text"])) for d in kept]
    copies = plain_copies(clean)
    tokenizer, want = Tokenizer.from_file(packing.tokenizer_path()), Counter()
    for d, _, text in clean:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, packing.END_ID], "<u4")
        for at in range(0, len(ids), packing.SEQUENCE):
            piece = ids[at:at + packing.SEQUENCE]
            want[d, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += copies[d]
    got = corpus_pipeline.run(spark, SF001).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == +want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(sequences) == [*range(len(sequences))]
    for pieces in sequences.values():  # without gaps or overlaps, in 4096 tokens
        ends = [0]
        for at, n in sorted(pieces):
            assert at == ends[-1]
            ends.append(at + n)
        assert ends[-1] <= packing.SEQUENCE
    used = sum(n for p in sequences.values() for _, n in p)
    assert len(sequences) * packing.SEQUENCE <= 1.05 * used + 2 * packing.SEQUENCE  # little padding
