"""Plain versions of the operators on conversations and of whitening."""

import hashlib
import re
import zlib

import numpy as np
import regex

PIECE = regex.compile(r" ?\p{L}{1,5}|\p{N}{1,3}|[^ \t\n\x0b\f\r\p{L}\p{N}]|[ \t\n\x0b\f\r]+")


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def by_conversation(rows, keep=lambda r: True):
    """Rows (conv_id, turn, role, text) of each conversation in order."""
    found = {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, []).append((turn, role, text))
    return {c: sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1], r[2]))) for c, rs in found.items()}


def escaped(text, role=False):
    text = text.replace("\\", "\\b").replace("<turn>", "\\lturn>").replace("</turn>", "\\l/turn>")
    return text.replace("\n", "\\n") if role else text


def chat(rows, budget, history, block):
    """conv_id -> (n_turns, turns, loss, formatted characters, longest window, new tokens beyond the budget)."""
    out = {}
    for conv, turns in by_conversation([(c, t, r or "", x or "") for c, t, r, x in rows]).items():
        tokens = [4 + len(PIECE.findall(r)) + len(PIECE.findall(x)) for _, r, x in turns]
        at = [sum(tokens[:k]) for k in range(len(tokens) + 1)]
        system = turns[0][1] == "system"
        room = max(budget - history - (tokens[0] if system else 0), 1)
        starts, used = [], 0
        for k in range(len(turns)):
            charge = 0 if k == 0 and system else tokens[k]
            new_block = at[-1] > block and k and at[k] // block != at[k - 1] // block
            if k == 0 or new_block or used + charge > room:
                starts.append(k)
                used = 0
            used += charge
        chars = 0
        for first, last in zip(starts, [*starts[1:], len(turns)]):
            repeated = [] if first == 0 else [0] * system + [k for k in range(first) if at[k] >= at[first] - history and not (system and k == 0)]
            chars += sum(len("<turn>" + escaped(turns[k][1], True) + "\n" + escaped(turns[k][2]) + "</turn>\n") for k in [*repeated, *range(first, last)])
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[conv] = len(turns), "".join(f"{r}\n{x}\n" for _, r, x in turns), loss, chars
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def cheapest(rows):
    """(cost, audit) of rows (initial, fault) by comparing whole audits."""
    after = {2: ("u", "a")}
    form = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    none = (10**9, "")

    def relaxed(best):
        while True:
            more = {q: min([best[q]] + [(5 + best[to][0], "I" + best[to][1]) for role, to in form[q].items() if role != "s"]) for q in form}
            if more == best:
                return best
            best = more

    best = relaxed({0: (0, ""), 1: none, 2: none, 3: (0, "")})
    for initial, fault in reversed(rows):
        now = {}
        for q in form:
            options = [(2 + best[q][0], "D" + best[q][1])]
            if fault in (None, "truncated"):
                more = 5 * (fault == "truncated")
                options += [(more + best[to][0], "K" + best[to][1]) for role, to in form[q].items() if role == initial]
                options += [(1 + more + best[to][0], "R" + best[to][1]) for role, to in form[q].items() if role != "s"]
            now[q] = min(options)
        best = relaxed(now)
    assert after
    return best[0]


def applied(turns, audit):
    """Repaired lines; the roles follow from the form."""
    kept, k = [], 0
    for letter in audit:
        if letter == "I":
            kept.append((None, ""))
            continue
        if letter != "D":
            kept.append((turns[k][1] if letter == "K" else None, turns[k][2]))
        k += 1
    assert k == len(turns)
    lead = len(kept) % 2
    lines = [(role if role is not None else ("user", "assistant")[(n - lead) % 2], text) for n, (role, text) in enumerate(kept)]
    assert re.fullmatch("(s?(ua)+)?", "".join(role[:1] for role, _ in lines))
    return lines


def repair(rows):
    """conv_id -> result row without the id."""
    found = by_conversation(damaged(rows))
    out = {}
    for conv in {r[0] for r in rows}:
        turns, seen, faults = found.get(conv, []), set(), []
        for _, role, text in turns:
            body = text.strip(" \t\n\x0b\f\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
            seen.add((role, text))
        numbers = {t for t, _, _ in turns if t is not None}
        initials = [r[:1] for _, r, _ in turns]
        cost, audit = cheapest(list(zip(initials, faults)))
        lines = applied(turns, audit)
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest())
    return out


def whitening(vectors, components=32):
    """(ids, n, deviations, whitened up to sign, explained) in plain numpy and Python integers."""
    kept = [(i, [float(c) for c in v]) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    sizes = [len(v) for _, v in kept]
    width = max(set(sizes), key=lambda s: (sizes.count(s), s)) if kept else 0
    kept = [(i, v) for i, v in kept if len(v) == width and width]
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = np.array(x, float) - np.array(sums, float) / max(n, 1)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    return [i for i, _ in kept], n, deviation, centred @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()
