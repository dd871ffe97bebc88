"""Plain versions of the operators, for small tables."""

import hashlib
import html
import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"


def words(text, lower=False):
    text = text or ""
    return re.findall("[^\x20\x09-\x0d]+", text.translate(LOWER) if lower else text)


def quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = set()
    for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)):
        if seen[g] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def line_dedup(docs, least=10):
    """docs: (id, text) pairs."""
    key = lambda x: x.strip(SPACE).translate(LOWER)
    holders = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= least:
                holders[key(x)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def shingles(text, k):
    w = words(text, True)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def components(docs, k, num, den):
    """docs: (id, text) pairs with ids that aren't null; id to smallest id reachable."""
    sets = [(i, shingles(t, k)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), order, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def main_text(page):
    """Path ratios on simple pages: elements nav, footer, aside, form and class ad are marked; only p ends by itself."""
    inline = {"a", "b", "i", "em", "span"}
    nodes, stack, skip, line, made = [], [], None, 0, 0
    for part in re.findall(r"<!--.*?-->|<[^>]*>|[^<]+", page, re.S):
        if skip:
            skip = None if part == f"</{skip}>" else skip
        elif not part.startswith("<"):
            if part.strip():
                marked = next((f for n, c, _ in stack for f in [0.0005 if n in ("nav", "footer", "aside", "form") else 0.005 if c == "ad" else None] if f), 1.0)
                nodes.append({"path": ("/".join(n for n, _, _ in stack), marked), "above": [i for _, _, i in stack], "names": [n for n, _, _ in stack], "mark": marked, "text": html.unescape(part), "line": line})
        elif m := re.match(r"<(/?)([a-z0-9]+)(?:.*class=\"?([a-z]+))?", part):
            end, name, css = m.groups()
            if name in ("script", "style", "title"):
                skip = None if end else name
            elif name == "br":
                nodes[-1]["text"] += "\n"
            elif name in ("meta", "img", "input", "link"):
                continue
            elif end:
                if name in [n for n, _, _ in stack]:
                    while True:
                        gone = stack.pop()[0]
                        line += gone not in inline
                        if gone == name:
                            break
            else:
                if name not in inline and "p" in [n for n, _, _ in stack]:
                    while stack.pop()[0] != "p":
                        pass
                line += name not in inline
                made += 1
                stack.append((name, css, made))
    by = defaultdict(list)
    for x in nodes:
        by[x["path"]].append(x["text"].strip())
    ratio = {p: p[1] * sum(map(len, t)) / len(t) * math.sqrt((sum(len(re.findall("[.,;:!?…、。，！？；：]", x)) for x in t) + 0.5) / len(t)) for p, t in by.items()}
    scores = defaultdict(list)
    for i, x in enumerate(nodes):
        near = [(math.exp(-(d * d) / 4), ratio[nodes[i + d]["path"]]) for d in (-2, -1, 0, 1, 2) if 0 <= i + d < len(nodes)]
        scores[x["path"]].append(math.sqrt(ratio[x["path"]] * sum(k * v for k, v in near) / sum(k for k, _ in near)))
    score = {p: sum(s) / len(s) for p, s in scores.items()}
    weights = [(x["mark"] * len(x["text"].strip()), score[x["path"]]) for x in nodes]
    mean = sum(w * s for w, s in weights) / sum(w for w, _ in weights)
    content = [x for x in nodes if score[x["path"]] >= mean / 4]
    holding = {e for x in content for e in x["above"]}
    out, last = [], None
    for x in nodes:
        if x not in content:
            depth = len([e for e in x["above"] if e in holding])
            if x["mark"] < 1 or not depth or depth < len(x["names"]) and (x["names"][depth - 1] in ("html", "body") or x["names"][depth] not in ("h1", "h2", "p", "ul", "b")):
                continue
        out.append(x["text"]) if x["line"] != last else out.append(out.pop() + x["text"])
        last = x["line"]
    return "\n\n".join(re.sub(r"\s+", " ", t).strip() for t in out)


def repair(rows: list[tuple]) -> tuple:
    """The result of a conversation's repair by a search over all edits: rows are (turn, role, text) in order."""
    seen, kinds = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    # every pair of rows done and role initials written, with the least (cost, audit) that leads there
    ways, steps = {"": {(0, "", ())}}, {"": "su", "s": "u", "u": "a", "a": "u"}

    def widen(ways: dict) -> dict:
        best = {q: min(w) for q, w in ways.items()}
        for _ in range(2):
            for q, (c, a, t) in list(best.items()):
                for r in steps[q].replace("s", ""):
                    new = (c + 5, a + "I", (*t, {"u": "user:", "a": "assistant:"}[r]))
                    best[r] = min(best.get(r, new), new)
        return best

    for (_, role, text), kind in zip(rows, kinds, strict=True):
        new: dict = {}
        for q, (c, a, t) in widen(ways).items():
            new.setdefault(q, set()).add((c + 2, a + "D", t))
            if kind in ("blank", "duplicate"):
                continue
            more = 5 * (kind == "truncated")
            if role[:1] and role[:1] in steps[q]:
                new.setdefault(role[:1], set()).add((c + more, a + "K", (*t, f"{role}:{text}")))
            for r, name in (("u", "user"), ("a", "assistant")):
                if r in steps[q]:
                    new.setdefault(r, set()).add((c + 1 + more, a + "R", (*t, f"{name}:{text}")))
        ways = new
    cost, audit, text = min(w for q, w in widen(ways).items() if q in ("", "a"))
    turns = {t for t, _, _ in rows if t is not None}
    bad = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:], strict=False))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), bad, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())


def runs(w: list) -> list[tuple]:
    """(start, end, period) of all runs of at least four periods and six words, period by period."""
    best: dict = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i:
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e, q) for (s, e), q in best.items())


def periodic(doc_id, text: str | None, repeated: bool) -> tuple:
    w = words(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if repeated and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs(w)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    first = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    best = (None,) * 4 if first is None else (first[0], first[1] - first[0], first[2], 1000 * (first[1] - first[0]) // first[2])
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(found), *best, digest("".join(f"{s},{e - s},{q}\n" for s, e, q in found)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def repeated_bytes(texts: list, least: int) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, kept) of each text: bytes of strings that stand twice go."""
    raws = [(t or "").encode() for t in texts]
    n = Counter(r[i : i + least] for r in raws for i in range(len(r) - least + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - least + 1):
            if n[r[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        out.append((len(r), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), bytes(b for b, g in zip(r, gone, strict=True) if not g)))
    return out
