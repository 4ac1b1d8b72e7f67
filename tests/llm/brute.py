"""Plain versions of the contracts, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def shingle_set(text, k=5):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_duplicates(rows):
    """rows of (doc_id, text) with distinct ids -> doc_id: (n_shingles, component_id)."""
    sets = [shingle_set(t) for _, t in rows]
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in by[x] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: (len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows)}


def mixing_targets(by_source, weights=(1, 2, 3), epochs=3.0):
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, done = sum(by_source.values()), {}
    while True:
        left = [s for s in order if s not in done]
        rest = total - sum(done.values())
        all_w = sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / all_w > epochs * by_source[s]] if left else []
        if not over:
            return done | {s: rest * weight[s] / all_w for s in left}
        done |= {s: epochs * by_source[s] for s in over}


def contamination(docs, items):
    def tok(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))

    windows = defaultdict(set)
    for item, text in items:
        w = tok(text)
        if w:
            n = min(13, len(w))
            for i in range(len(w) - n + 1):
                windows[tuple(w[i : i + n])].add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for d, text in docs:
        w, hit, found = tok(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[k]
        ids = ",".join(sorted(map(str, found)))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def lm_base(rows):
    """doc_id -> (tokens, base score to 6 digits), counts from the training documents."""
    of = {i: words(t) + [None] for i, t in rows}
    count = Counter(w for i, ws in of.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(count.values()), len(count)
    return {i: (len(ws), round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in of.items()}


def repeats(docs, n=400):
    """rows of (doc_id, text) -> list of (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for (d, _), t in zip(docs, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def tokenizers_of(folder="/opt/tokenizers"):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{folder}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")


def aligned(texts, tokenizers=None):
    """texts -> (n_a, n_b, n_groups, n_links, n_best, count_sum, groups), whole texts through both tokenizers."""
    a, b = tokenizers or tokenizers_of()
    own = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x]
    back = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(sorted(set(range(256)) - set(own)))}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    done = []
    for t in texts:
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        of_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        of_b = [piece(i) for i in ids_b]
        if not t or not b"".join(of_a) == b"".join(of_b) == (" " + t).encode():
            done.append(None)
            continue
        spans = []
        for parts in (of_a, of_b):
            at, got = 0, []
            for x in parts:
                got.append((at, at + len(x)))
                at += len(x)
            spans.append(got)
        both = {e for _, e in spans[0]} & {e for _, e in spans[1]}
        groups, i, j = [], 0, 0
        for e in sorted(both):
            ga, gb = [], []
            while i < len(ids_a) and spans[0][i][1] <= e:
                ga.append(ids_a[i])
                i += 1
            while j < len(ids_b) and spans[1][j][1] <= e:
                gb.append(ids_b[j])
                j += 1
            groups.append((ga, gb))
        links, j0 = [], 0
        for x, (p, q) in zip(ids_a, spans[0]):
            while spans[1][j0][1] <= p:
                j0 += 1
            j = j0
            while j < len(ids_b) and spans[1][j][0] < q:
                links.append((x, ids_b[j]))
                j += 1
        done.append((len(ids_a), len(ids_b), groups, links))
    count = Counter(x for d in done if d for x in d[3])
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for d in done:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in d[2])
            out.append((d[0], d[1], len(d[2]), len(d[3]), sum(count[x] == most[x[1]] for x in d[3]), sum(count[x] for x in d[3]), text))
    return out


def damaged(rows):
    """rows of (conv_id, turn, role, text) after the contract's damage; and all conversation ids."""
    import zlib

    out = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 1:
            text = ""
        elif k == 2:
            text = re.sub("[.!?]", "", text)
        elif k == 4:
            role = "user"
        out += [(c, t, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out, {r[0] for r in rows}


def repaired(rows, ids):
    """conv_id -> (gaps, blank, duplicate, truncated, illegal, cost, audit, text), by a plain table of best edits row by row."""
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role, text))
    out = {}
    for c in ids:
        got = sorted(by[c])
        turns = {t for known, t, _, _ in got if known}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, faults = set(), []
        for _, _, role, text in got:
            last = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(got, got[1:]))
        put = {"": "u", "s": "u", "u": "a", "a": "u"}
        full = {"u": "user", "a": "assistant"}

        def inserted(best):
            for _ in range(3):
                for q, (cost, audit, lines) in list(best.items()):
                    new = (cost + 2, audit + "I", (*lines, full[put[q]] + ":"))
                    if put[q] not in best or new < best[put[q]]:
                        best[put[q]] = new
            return best

        best = {"": (0, "", ())}
        for (_, _, role, text), fault in zip(got, faults):
            new = {}

            def offer(q, x, new=new):
                if q not in new or x < new[q]:
                    new[q] = x

            for q, (cost, audit, lines) in inserted(best).items():
                offer(q, (cost + 3, audit + "D", lines))
                if fault in ("blank", "duplicate"):
                    continue
                cut = fault == "truncated"
                ini = role[:1]
                if (ini == "s" and q == "") or (ini and ini == put[q]):
                    offer(ini, (cost + cut, audit + "K", (*lines, role + ":" + text)))
                offer(put[q], (cost + 2 + cut, audit + "R", (*lines, full[put[q]] + ":" + text)))
            best = new
        ends = inserted(best)
        cost, audit, lines = min(ends[q] for q in ("", "a") if q in ends)
        out[c] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, "\n".join(lines))
    return out
