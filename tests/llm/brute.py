"""Plain single-threaded versions of what the queries return."""

import hashlib
import re
import zlib

import numpy as np
import xxhash


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


def op1(page_id, url):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = low(host)
    best = None
    for act, h, p in [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (not best or len(h + p) > len(best[1])):
            best = (act, h + p)
    return (page_id, host, path, best and best[1], best[0] if best else "allow")


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def op2(doc_id, text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    places = []
    for p, lab in PHRASES.items():
        k = p.split()
        places += [(i, lab) for i in range(len(w)) if w[i : i + len(k)] == k]
    at = [i for i, _ in places]
    return (doc_id, len(w), len(places), min(at) if at else None, max(at) if at else None, ",".join(sorted({x for _, x in places})))


def op6_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    if not sh:
        return 0
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(ids, links):
    """The smallest member reachable, of each id."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def op6(rows):
    fp = {d: op6_print(t) for d, t in rows}
    ids = sorted(fp)
    a = np.array([fp[i] for i in ids], np.uint64)
    links = [(ids[i], ids[j]) for i in range(len(ids)) for j in (np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= 4) + i + 1).tolist()]
    comp = classes(ids, links)
    return {(i, f"{fp[i]:016x}", comp[i]) for i in ids}


def similar(rows):
    """component of each doc_id, linked by fingerprints or by sets of 5-word shingles."""
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    links = [(d, c) for d, _, c in op6(rows)]
    ids = sorted(sets)
    links += [(a, b) for a in ids for b in ids if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0)]
    return classes(ids, links)


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def op9(doc_id, text):
    text = text or ""
    a = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    k = [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    h = [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    order = ["assign", "access", "hex"]
    spans = sorted(a + k + h, key=lambda s: (s[1], order.index(s[0])))
    base = ",".join(f"{x}:{i}:{j}" for x, i, j in spans)
    return (doc_id, len(a), len(k), len(h), hashlib.sha256(base.encode()).hexdigest()), base


def words7(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def distance7(item, text):
    """Least edits between the item's words and a stretch of the text's."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def ids_of(texts, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    return [[*e.ids, end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def op3(rows):
    rows = sorted(rows)
    out, at = set(), 0
    for (d, _), ids in zip(rows, ids_of([t for _, t in rows], 2)):
        out.add((d, at, len(ids), crc(ids)))
        at += len(ids)
    return out


def check_packing(rows, pieces, capacity=2048):
    """pieces: dicts of op8's columns. Gives the share of padding."""
    ids = dict(zip([d for d, _ in rows], ids_of([t for _, t in rows], 1)))
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(ids)
    for d, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids[d])
            assert p["ids_crc32"] == crc(ids[d][at : at + p["length"]])
            at += p["length"]
        assert at == len(ids[d])
    pad = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
        pad += capacity - at
    return pad / (capacity * len(by_seq))
