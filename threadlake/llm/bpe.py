"""Byte-level BPE with an exact token count for every prefix.

The encoding of a prefix is the encoding of a shorter prefix plus one token, and
that token is the only one that ends there and can stand beside the token before
it. So one pass over the bytes of a pre-token finds, for each prefix, its last
token and its count, from the counts of shorter prefixes alone. Truncation and
budget questions are then look-ups.
"""

from __future__ import annotations

import base64
import json
from pathlib import Path

import regex

#: Pieces remembered by a worker; beyond, the memo starts anew.
MEMO = 1_200_000
#: A space that the next pre-token need not take.
LOOSE_SPACE = regex.compile(r" (?:\s|$)")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that vocabulary files use for bytes.

    Bytes that print as themselves in Latin-1 stand for themselves; the others
    take the code points from 256 on, in order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = {}, 256
    for b in range(256):
        out[chr(b if b in plain else spare)] = b
        spare += b not in plain
    return out


class Vocabulary:
    """Ids by token bytes, how each token was merged, and the special strings of a tokenizers file."""

    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        alphabet = byte_alphabet()
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.ids = {bytes(alphabet[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.bytes = {i: b for b, i in self.ids.items()}
        #: Rank by pair of ids; and by id the pair it came from with the rank of that merge.
        self.merge: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for k, m in enumerate(spec["model"]["merges"]):
            x, y = m.split(" ") if isinstance(m, str) else m
            x, y = bytes(alphabet[c] for c in x), bytes(alphabet[c] for c in y)
            left, right, whole = self.ids[x], self.ids[y], self.ids[x + y]
            self.merge[left, right] = k
            self.made.setdefault(whole, (left, right, k))
        self.longest = max(map(len, self.ids))

    def stand(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' bytes leaves just these two.

        Goes back in time: the later made of the two tokens at the border is
        undone, and until then no merge across the border may have been due. Of
        equal ranks the leftmost merge comes first, hence the half.
        """
        due = float("inf")
        merge, made = self.merge, self.made
        while True:
            rank = merge.get((left, right))
            if rank is not None and rank < due:
                return False
            x, y = made.get(left), made.get(right)
            if x is None and y is None:
                return True
            if y is None or x is not None and x[2] > y[2]:
                left, due = x[1], x[2]
            else:
                right, due = y[0], y[2] + 0.5


class PrefixCounter:
    """Counts of every prefix of a pre-token, and of texts through a memo of pieces."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, memo: int = MEMO) -> None:
        self.vocabulary = vocabulary
        self.pattern = regex.compile(pattern)
        self.known: dict[int, bool] = {}
        self.first, self.spaced = _Memo(lambda p: self.piece_count(p), memo // 10), _Memo(lambda p: self.piece_count(" " + p), memo)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True))) if vocabulary.special else None

    def prefixes(self, token_text: bytes) -> tuple[list[int], list[int]]:
        """counts[i] and last[i]: tokens of the first i bytes, and the id of the last of them."""
        ids, longest, stand = self.vocabulary.ids.get, self.vocabulary.longest, self.vocabulary.stand
        known = self.known
        counts, last = [0], [-1]
        for end in range(1, len(token_text) + 1):
            for start in range(max(0, end - longest), end):
                token = ids(token_text[start:end])
                if token is None:
                    continue
                if start:
                    pair = last[start] << 20 | token
                    fits = known.get(pair)
                    if fits is None:
                        if len(known) >= MEMO:
                            known.clear()
                        fits = known[pair] = stand(last[start], token)
                if start == 0 or fits:
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
            else:
                raise ValueError("a byte has no token")
        return counts, last

    def piece_count(self, piece: str) -> int:
        return sum(self.prefixes(p.encode())[0][-1] for p in self.pattern.findall(piece))

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        if LOOSE_SPACE.search(text):
            return sum(map(self.first.__getitem__, pieces(text)))
        head, *rest = text.split(" ")
        return (self.first[head] if head else 0) + sum(map(self.spaced.__getitem__, rest))

    def count(self, text: str) -> int:
        """Tokens of a text; special strings in it are one token each."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return sum(map(self._plain, parts)) + len(parts) - 1

    def fitting_bytes(self, text: str, budget: int) -> int:
        """Bytes of the text that its first ``budget`` tokens cover."""
        done = used = 0
        parts = self.special.split(text) if self.special else [text]
        marks = [*(self.special.findall(text) if self.special else []), ""]
        for part, mark in zip(parts, marks, strict=True):
            for piece in pieces(part):
                n = self.spaced[piece[1:]] if piece[0] == " " else self.first[piece]
                if used + n <= budget:
                    used, done = used + n, done + len(piece.encode())
                    continue
                for token_text in map(str.encode, self.pattern.findall(piece)):
                    counts, last = self.prefixes(token_text)
                    if used + counts[-1] <= budget:
                        used, done = used + counts[-1], done + len(token_text)
                        continue
                    end = len(token_text)
                    while counts[end] > budget - used:
                        end -= len(self.vocabulary.bytes[last[end]])
                    return done + end
            if mark:
                if used == budget:
                    return done
                used, done = used + 1, done + len(mark.encode())
        return done

    def prefix_count(self, text: str, n_bytes: int) -> int:
        """Tokens of the longest whole-character prefix of at most n_bytes bytes."""
        return self.count(text.encode()[:n_bytes].decode(errors="ignore"))


class _Memo(dict):
    """Values by piece; when full, the older half goes and what is still used comes back."""

    def __init__(self, make, limit: int) -> None:
        self.make, self.limit, self.old = make, max(1, limit // 2), {}

    def __missing__(self, piece: str):
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = value
        return value


def pieces(text: str) -> list[str]:
    """Cuts a text before each space that a non-space follows.

    No pre-token crosses such a cut: the space joins what follows it, and white
    space before it ends there, whatever comes after.
    """
    parts = text.split(" ")
    if len(parts) == 1:
        return parts if text else []
    if "" in parts[1:] or any(map(_leads_with_space, parts)):
        out = [parts[0]]
        for p in parts[1:]:
            if not p or p[0].isspace():
                out[-1] += " " + p
            else:
                out.append(" " + p)
        return out if out[0] else out[1:]
    out = [" " + p for p in parts]
    out[0] = parts[0]
    return out if parts[0] else out[1:]


def _leads_with_space(part: str) -> bool:
    return part[:1].isspace()


def tiktoken_ranks(path: str) -> dict[bytes, int]:
    """Ids by token bytes of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
