"""Plain Python versions of the operators."""

import base64
import collections
import hashlib
import math
import re
import string
import zlib

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def secrets(text):
    t = text or ""
    a = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    b = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    c = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    spans = ",".join(f"{('assign', 'access', 'hex')[k]}:{x}:{y}" for x, k, y in sorted(a + b + c))
    return len(a), len(b), len(c), hashlib.sha256(spans.encode()).hexdigest()


def linked_secrets(text, scope=200):
    """All spans of a text: the base ones, and the weak ones that lie within *scope* of their complements, by trying all pairs."""
    t = text or ""
    from loomgraph.llm.secrets import LOGIN, TOKEN, URL

    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    weak = [(m.start(), k, m.end()) for k, p in ((3, LOGIN), (4, TOKEN), (5, URL)) for m in re.finditer(p, t)]
    parts = base + weak
    near = lambda x, kinds: any(y is not x and y[1] in kinds and y[0] <= x[2] + scope and y[2] >= x[0] - scope for y in parts)
    needs = {3: [(0, 2, 4)], 4: [(1, 3)], 5: [(1, 3), (0, 2, 4)]}
    told = [x for x in weak if all(near(x, k) for k in needs[x[1]]) and not any(y[0] < x[2] and y[2] > x[0] for y in base)]
    names = ("assign", "access", "hex", "login", "token", "url")
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(base + told))


def tiled(doc, item, least=5):
    """Words of *item* that plain greedy string tiling marks: of all longest common runs of unmarked words the first by (place in doc, place in item), again and again."""
    least = min(least, len(item))
    in_doc, in_item, covered = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                k = 0
                while d + k < len(doc) and i + k < len(item) and doc[d + k] == item[i + k] and not in_doc[d + k] and not in_item[i + k]:
                    k += 1
                best = max(best, (k, -d, -i))
        k, d, i = best[0], -best[1], -best[2]
        if k < least or not k:
            return covered
        for j in range(k):
            in_doc[d + j] = in_item[i + j] = True
        covered += k


def near_duplicates(rows, width, percent):
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = set(zip(*[w[i:] for i in range(width)])) if len(w) >= width else ({tuple(w)} if w else set())
    having = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            having[x].append(d)
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for d, s in sets.items():
        for e, k in collections.Counter(e for x in s for e in having[x] if e < d).items():
            if 100 * k >= percent * (len(s) + len(sets[e]) - k):
                a, b = find(d), find(e)
                up[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def repeats(rows, span=50):
    """Rows (id, bytes, removed, spans, digest, kept); a null id counts as larger than all."""
    rows = [(1 << 62 if d is None else d, t) for d, t in rows]
    first = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for i in range(len(b) - span + 1):
            first.setdefault(b[i : i + span], d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if first[b[i : i + span]] < d:
                mark[i : i + span] = b"\1" * span
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out.append((d, len(b), sum(mark), sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1])), hashlib.sha256(kept).hexdigest(), kept))
    return out


def warc(rows, min_bytes=0):
    least = {}
    for i, h in rows:
        h = (h or "").encode()
        if len(h) >= min_bytes:
            least[h] = min(least.get(h, i), i)
    out = {}
    for i, h in rows:
        h = (h or "").encode()
        f = least.get(h, i)
        out[i] = (len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if f == i else "revisit", None if f == i else f)
    return out


def katz(rows, order=3):
    """(held out, tokens, known, N, base, score) by id, and the sums of distributions of all orders."""
    from loomgraph.llm.katz import K, GoodTuring

    texts = [(d, [*words(t), None], d is not None and zlib.crc32(str(d).encode()) % 7 == 2) for d, t in rows]
    grams = [collections.Counter() for _ in range(order + 1)]
    for _, w, held in texts:
        if not held:
            padded = ["<s>"] * (order - 1) + w
            for k in range(1, order + 1):
                for i in range(order - 1, len(padded)):
                    grams[k][tuple(padded[i - k + 1 : i + 1])] += 1
    c = grams[1]
    n, v = sum(c.values()), len(c)
    turing = [GoodTuring([sum(1 for x in g.values() if x == r) for r in range(1, K + 2)]) for g in grams]
    cut = lambda k, r: r * (turing[k].ratio[r] if r <= K else 1)
    after = [collections.defaultdict(list) for _ in grams]
    for k in range(2, order + 1):
        for g, r in grams[k].items():
            after[k][g[:-1]].append((g[-1], r))
    left = n - sum(cut(1, x) for x in c.values())
    total = n if left > 1e-9 else n + 1
    unknown = (left if left > 1e-9 else 1) / total
    back = {}

    def p(h, w):
        if not h:
            return cut(1, c[(w,)]) / total if (w,) in c else unknown
        k = len(h) + 1
        found = after[k].get(h)
        if not found:
            return p(h[1:], w)
        if h not in back:
            rest = sum(r - cut(k, r) for _, r in found)
            whole = sum(r for _, r in found) + (0 if rest > 1e-9 else 1)
            back[h] = (whole, (rest if rest > 1e-9 else 1) / whole / (1 - sum(p(h[1:], y) for y, _ in found)))
        whole, alpha = back[h]
        r = grams[k].get((*h, w), 0)
        return cut(k, r) / whole if r else alpha * p(h[1:], w)

    sums = [sum(p((), w) for (w,) in c) + unknown]
    for k in range(2, order + 1):
        for h in list(after[k])[:25]:
            sums.append(sum(p(h, w) for (w,) in c) + p(h, "never seen"))
    out = {}
    for d, w, held in texts:
        padded = ["<s>"] * (order - 1) + w
        score = sum(math.log10(p(tuple(padded[i - order + 1 : i]), padded[i])) for i in range(order - 1, len(padded)))
        out[d] = (held, len(w), sum((y,) in c for y in w), n, sum(math.log10((c[(y,)] + 1) / (n + v + 1)) for y in w), score)
    return out, sums


# operator 11


def spelling(rows):
    """(word, form, root, n, n_near, form_n) of rows (doc_id, text)."""
    import collections
    import re
    import zlib

    seen = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            at = h % len(word)
            seen[word[:at] + word[at + 1 :] if h % 97 == 0 else word] += 1
    counts = {w: n for w, n in seen.items() if n >= 3 and len(w) >= 5}
    near = collections.defaultdict(set)
    for a in counts:
        for b in counts:
            if abs(len(a) - len(b)) <= 1 and a != b and one_edit(a, b):
                near[a].add(b)
    form = {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 2 * counts[w]:
            form[w] = best
    out = []
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None))
    return out


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


# operator 12


def aligned(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of texts, by trying token against token."""
    import collections
    import hashlib
    from itertools import accumulate

    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a_tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_tool.encode_special_tokens = True
    b_tool = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}

    def one(text):
        if not text:
            return None
        a, b = a_tool.encode(" " + text, add_special_tokens=False).ids, b_tool.encode(text)
        bytes_a = [bytes(shown[c] for c in a_tool.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(b_tool.id_to_piece(i)[3:5], 16)]) if b_tool.is_byte(i) else b_tool.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return None
        end_a, end_b = list(accumulate(map(len, bytes_a))), list(accumulate(map(len, bytes_b)))
        from_a, from_b = [0, *end_a], [0, *end_b]
        links, first = [], 0
        for i in range(len(a)):
            while end_b[first] <= from_a[i]:
                first += 1
            j = first
            while j < len(b) and from_b[j] < end_a[i]:
                links.append((a[i], b[j]))
                j += 1
        groups, last = [], 0
        for cut in sorted(set(end_a) & set(end_b)):
            part = [",".join(str(x) for x, e in zip(ids, ends) if last < e <= cut) for ids, ends in ((a, end_a), (b, end_b))] if len(a) < 500 else None
            groups.append("|".join(part) if part else None)
            last = cut
        told = hashlib.sha256(";".join(groups).encode()).hexdigest() if len(a) < 500 else None
        return len(a), len(b), len(groups), links, told

    rows = [one(t) for t in texts]
    count = collections.Counter(x for r in rows if r for x in r[3])
    most = collections.defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(count[x] == most[x[1]] for x in r[3]), sum(count[x] for x in r[3]), r[4]) for r in rows]
