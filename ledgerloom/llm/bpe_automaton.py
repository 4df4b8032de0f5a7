"""Byte-pair encoding as a deterministic token automaton.

The merges are compiled one by one with a merge gadget. The automaton reads tokens; it starts
as one state that loops on every byte. The gadget for a merge (u, v) -> w copies the state that
u leads to without its transition on v, redirects u to the copy, and lets w go from every
state that u leaves to the state that v leads to. At the end it accepts exactly the token
sequences that byte-pair encoding produces, so every text has one accepted path.

All transitions on one label lead to one state, and each merge makes one state, so the whole
automaton is three tables over merges (parent state, removed label, left part of the new label)
and one over labels (the state it leads to). A transition exists unless an ancestor of the state
removed the label, or an older ancestor removed the part that the label was made from.
"""

from __future__ import annotations

import json
from bisect import bisect_right

BYTES = 256


def printable_bytes() -> dict[str, int]:
    """The usual printable stand-ins of byte-level vocabularies: visible Latin-1 bytes stand for
    themselves, the others take the code points from 256 in order."""
    visible = [b for b in range(BYTES) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {chr(b): b for b in visible}
    rest = (b for b in range(BYTES) if b not in set(visible))
    out.update({chr(BYTES + k): b for k, b in enumerate(rest)})
    return out


class TokenAutomaton:
    """Compiled merges; encode() follows the accepted path of a word's bytes."""

    def __init__(self, byte_ids: list[int], merges: list[tuple[bytes, bytes]], ids: dict[bytes, int]):
        label: dict[bytes, int] = {bytes([b]): b for b in range(BYTES)}
        self.emit = list(byte_ids)
        self.left = [-1] * BYTES
        self.born = [-1] * BYTES
        self.leads_to = [0] * BYTES
        parent, removed = [-1], [-1]
        for step, (u_text, v_text) in enumerate(merges):
            u, v, w = label[u_text], label[v_text], len(self.emit)
            at_u, at_v = self.leads_to[u], self.leads_to[v]
            label.setdefault(u_text + v_text, w)
            parent.append(at_u)
            removed.append(v)
            self.leads_to[u] = step + 1
            self.emit.append(ids[u_text + v_text])
            self.left.append(u)
            self.born.append(step)
            self.leads_to.append(at_v)
        self._intervals(parent, removed)
        self.longest = max(map(len, label))
        self.arcs: dict[int, int] = {}
        self.final: list[int] = [-1]
        for text, k in label.items():
            node = 0
            for b in text:
                key = node << 8 | b
                node = self.arcs.get(key, -1)
                if node < 0:
                    node = self.arcs[key] = len(self.final)
                    self.final.append(-1)
            self.final[node] = k
        self._seen: dict[int, bool] = {}
        self.label = label

    def _intervals(self, parent: list[int], removed: list[int]) -> None:
        """Depth-first numbers of the tree of copies; per label the subtrees that lack it."""
        n = len(parent)
        children: list[list[int]] = [[] for _ in range(n)]
        for q in range(1, n):
            children[parent[q]].append(q)
        self.enter, leave, clock, stack = [0] * n, [0] * n, 0, [0]
        while stack:
            q = stack.pop()
            if q < 0:
                leave[~q] = clock
                continue
            self.enter[q] = clock
            clock += 1
            stack.append(~q)
            stack.extend(children[q])
        self.without: dict[int, tuple[list[int], list[int], list[int]]] = {}
        for q in sorted(range(1, n), key=self.enter.__getitem__):
            a = self.without.setdefault(removed[q], ([], [], []))
            a[0].append(self.enter[q])
            a[1].append(leave[q])
            a[2].append(q - 1)

    def spelling(self) -> dict[int, bytes]:
        """The bytes of every id."""
        return {self.emit[k]: text for text, k in self.label.items()}

    def allows(self, state: int, token: int) -> bool:
        """Whether the state has a transition on the token."""
        key = state << 20 | token
        known = self._seen.get(key)
        if known is not None:
            return known
        at, limit, label, ok = self.enter[state], 1 << 60, token, True
        while label >= 0:
            cuts = self.without.get(label)
            if cuts is not None:
                k = bisect_right(cuts[0], at) - 1
                if k >= 0 and at < cuts[1][k] and cuts[2][k] <= limit:
                    ok = False
                    break
            limit, label = self.born[label], self.left[label]
        if len(self._seen) > 2_000_000:
            self._seen.clear()
        self._seen[key] = ok
        return ok

    def encode(self, word: bytes) -> list[int]:
        """Ids along the one accepted path. Each prefix has one accepted path as well, so a
        single pass keeps one arc per position."""
        n = len(word)
        came: list[int] = [-1] * (n + 1)
        start = [0] * (n + 1)
        arcs, final, allows, leads_to = self.arcs, self.final, self.allows, self.leads_to
        for i in range(n):
            if i and came[i] < 0:
                continue
            state, node = leads_to[came[i]] if i else 0, 0
            for j in range(i, n):
                node = arcs.get(node << 8 | word[j], -1)
                if node < 0:
                    break
                token = final[node]
                if token >= 0 and came[j + 1] < 0 and allows(state, token):
                    came[j + 1], start[j + 1] = token, i
        out, j = [], n
        while j > 0:
            out.append(self.emit[came[j]])
            j = start[j]
        out.reverse()
        return out


def load_byte_bpe(path: str) -> TokenAutomaton:
    """From a tokenizers JSON file with a byte-level vocabulary and its list of merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    stand_in = printable_bytes()
    raw = {piece: bytes(stand_in[c] for c in piece) for piece in model["vocab"] if all(c in stand_in for c in piece)}
    ids = {raw[p]: k for p, k in model["vocab"].items() if p in raw}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return TokenAutomaton([ids[bytes([b])] for b in range(BYTES)], [(raw[u], raw[v]) for u, v in pairs], ids)
