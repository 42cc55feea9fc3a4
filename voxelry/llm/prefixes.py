"""Encodings of all prefixes of a string, by one token for each prefix.

A vocabulary of merges turns a string into tokens by merging, again and again, the adjacent pair whose union comes first
in the order of merges, the leftmost of equals. A sequence of tokens is what merging gives for its text exactly if this
holds for every two neighbours in it: merges within different tokens do not disturb each other, so that the first merge
across a border would also happen in the text of the two tokens alone. So every prefix of a text has one token that can
end its encoding: the one that ends the prefix and may follow the last token of the prefix before it. An automaton finds the
tokens that end at each place; the array of last tokens is carried on character by character and read backwards.
"""

from __future__ import annotations

import math

import ahocorasick

PAIRS_KNOWN = 1_600_000


class PrefixTable:
    """Last tokens of prefixes, under ``ids`` (token -> id) and ``order`` (token -> place in the order of merges, lower first).

    Characters that are no tokens stand for themselves, with the id ``-1 - ord(character)``, unless ``closed``: then they
    are an error. Known pairs of tokens are kept up to PAIRS_KNOWN.
    """

    def __init__(self, ids: dict[str, int], order: dict[str, int], closed: bool = False):
        self.order, self.closed = order, closed
        self.longest = max(map(len, ids), default=1)
        self.token = {i: t for t, i in ids.items()}
        self.endings = ahocorasick.Automaton()
        for t, i in ids.items():
            self.endings.add_word(t, (i, len(t)))
        self.endings.make_automaton()
        seen: set[int] = set()
        self._tied = {o for o in order.values() if o in seen or seen.add(o)}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._splits: dict[str, tuple[str, str, int] | None] = {}
        self._alone: dict[int, bool] = {}

    def text(self, token: int) -> str:
        return self.token[token] if token >= 0 else chr(-1 - token)

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        parts, last = list(text), None
        while len(parts) > 1:
            best, at = min((self.order.get(a + b, math.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == math.inf:
                break
            last = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, last

    def merged(self, text: str) -> list[str]:
        """The definition: merge the adjacent pair whose union comes first, leftmost first, until no union is a token."""
        return self._merge(text)[0]

    def split(self, token: str) -> tuple[str, str, int] | None:
        """The halves that the last merge of a token joins, and when; a single character is there from the start, at -1.

        None for tokens that merging does not make or makes out of order, and for those that share their place with others.
        """
        if token in self._splits:
            return self._splits[token]
        found = None
        if len(token) == 1:
            found = "", "", -1
        else:
            parts, halves = self._merge(token)
            when = self.order.get(token)
            if len(parts) == 1 and when not in self._tied:
                sides = [self.split(h) for h in halves]
                if all(s is not None and s[2] < when for s in sides):
                    found = *halves, when
        self._splits[token] = found
        return found

    def may_start(self, token: int) -> bool:
        known = self._alone.get(token)
        if known is None:
            known = self._alone[token] = self.split(self.text(token)) is not None or len(self.merged(self.text(token))) == 1
        return known

    def may_follow(self, first: int, second: int) -> bool:
        known = self._pairs.get((first, second))
        if known is None:
            if len(self._pairs) >= PAIRS_KNOWN:
                self._pairs.clear()
            known = self._pairs[first, second] = self._compatible(self.text(first), self.text(second))
        return known

    def _compatible(self, a: str, b: str) -> bool:
        """Whether merging the text of both gives both: no merge across the border comes before those that hide its halves.

        The merges on both sides of the border are undone, latest first; while two halves face each other, their union must
        not come before the merge that ends this state.
        """
        left, right = self.split(a), self.split(b)
        if left is None or right is None:
            return self.merged(a + b) == [a, b]
        until = math.inf
        while True:
            if self.order.get(a + b, math.inf) < until:
                return False
            if left[2] > right[2]:
                until, a = left[2], left[1]
                left = self.split(a)
            elif right[2] >= 0:
                until, b = right[2] + 1, right[0]  # of equal merges the one across the border lies further left
                right = self.split(b)
            else:
                return True

    def extend(self, last: list[int], text: str, stop: int | None = None) -> list[int]:
        """Carries on ``last`` (the last token of each prefix computed so far) to all prefixes of ``text[:stop]``."""
        pairs, done, stop = self._pairs, len(last), len(text) if stop is None else stop
        begin = max(0, done + 1 - self.longest)
        for end, (token, size) in self.endings.iter(text, begin, stop):  # at each end the longest token first
            if end != done:
                if end < done:
                    continue
                self._fill(last, text, end)
                done = end
            if size > end:
                fits = self.may_start(token)
            else:
                before = last[end - size]
                fits = pairs.get((before, token))
                if fits is None:
                    fits = self.may_follow(before, token)
            if fits:
                last.append(token)
                done += 1
        self._fill(last, text, stop)
        return last

    def _fill(self, last: list[int], text: str, stop: int) -> None:
        """Where no token of the vocabulary fits, the character itself is the one that does."""
        if len(last) < stop and self.closed:
            raise ValueError(f"the vocabulary lacks {text[len(last)]!r}")
        last.extend(-1 - ord(c) for c in text[len(last) : stop])

    def tokens_of(self, last: list[int]) -> list[int]:
        """The encoding that ends with the last token of the longest prefix, read backwards."""
        ids, end, token = [], len(last), self.token
        while end:
            ids.append(last[end - 1])
            end -= len(token[last[end - 1]]) if last[end - 1] >= 0 else 1
        return ids[::-1]

    def edit(self, last: list[int], text: str, start: int, stop: int, new: str) -> list[int]:
        """The last tokens after ``text[start:stop]`` has become ``new``; only the surroundings of the edit are read.

        Once as many successive prefixes as the longest token has characters end as before, all later ones do.
        """
        low = max(0, start - self.longest)
        window, fresh = text[low:start] + new, last[low:start]
        self.extend(fresh, window)
        at, same = stop, 0  # place in the old text
        while at < len(text) and same < self.longest:
            more = text[at : at + self.longest]
            window = window[-self.longest :] + more  # the tail is all that a token ending in ``more`` can reach back to
            tail = fresh[-self.longest :]
            tail = self.extend(tail, window)[len(window) - len(more) :]
            fresh += tail
            for token in tail:
                same = same + 1 if last[at] == token else 0
                at += 1
        return last[:low] + fresh + last[at:]
