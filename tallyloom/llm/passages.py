"""How much of a short text stands in a long one, in running passages; typing slips and inserted words aside. Plain Python, for one pair."""

from __future__ import annotations

from collections import defaultdict

#: Letters of an exact seed, of the longest gap in the item within a passage, of words inserted there, and of the shortest passage.
SEED, GAP, INSERTED, PASSAGE = 6, 14, 40, 40


def seeds_of(item: str) -> dict[str, list[int]]:
    """Positions of each run of SEED letters."""
    at: dict[str, list[int]] = defaultdict(list)
    for i in range(len(item) - SEED + 1):
        at[item[i : i + SEED]].append(i)
    return at


def edits(a: str, b: str, most: int) -> int:
    """Edit distance, or ``most + 1`` if it is greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return most + 1
        row = new
    return row[-1]


def exact_runs(item: str, seeds: dict[str, list[int]], text: str) -> list[tuple[int, int, int]]:
    """(start in text, start in item, length) of all maximal common runs of SEED letters or more."""
    reached: dict[int, int] = {}  # diagonal -> end in text of its last run
    runs = []
    for j in range(len(text) - SEED + 1):
        for i in seeds.get(text[j : j + SEED], ()):
            if reached.get(i - j, -1) > j:
                continue
            n = SEED
            while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n]:
                n += 1
            reached[i - j] = j + n
            runs.append((j, i, n))
    return runs


def joined(item: str, text: str, p: tuple[int, int, int], q: tuple[int, int, int]) -> bool:
    """Whether run q carries on run p: a slip or an inserted word lies between them, or little enough that is different."""
    lost, more = q[1] - (p[1] + p[2]), q[0] - (p[0] + p[2])
    if lost < -SEED or more < -SEED or lost > GAP or more > max(lost, 0) + INSERTED or q[1] <= p[1] or q[0] <= p[0]:
        return False
    if lost <= 3:
        return True
    most = max(2, round(0.4 * lost))
    return edits(item[p[1] + p[2] : q[1]], text[p[0] + p[2] : q[0]], most) <= most


def coverage(item: str, seeds: dict[str, list[int]], text: str) -> float:
    """Share of the item's letters that passages of ``text`` cover; a passage is a chain of exact runs."""
    if not item:
        return 0.0
    runs = exact_runs(item, seeds, text)
    chains: list[list] = []  # [first position in item, last run]
    open_at: dict[int, list] = {}
    for q in runs:
        best = None
        for k in sorted(open_at, reverse=True):
            c = open_at[k]
            if q[0] - (c[1][0] + c[1][2]) > GAP + INSERTED:
                del open_at[k]
            elif joined(item, text, c[1], q) and (best is None or c[1][1] + c[1][2] - c[0] > open_at[best][1][1] + open_at[best][1][2] - open_at[best][0]):
                best = k
        if best is None:
            chain = [q[1], q]
            chains.append(chain)
            open_at[len(chains) - 1] = chain
        else:
            open_at[best][1] = q
    covered = bytearray(len(item))
    for first, last in chains:
        end = last[1] + last[2]
        if end - first >= min(PASSAGE, len(item)):
            covered[first:end] = b"\x01" * (end - first)
    return sum(covered) / len(item)
