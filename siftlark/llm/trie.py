"""A compact trie of words with counts, and its intersection with distance-one Levenshtein automata."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from typing import NamedTuple

#: Two characters that no word holds end every word, so that its automaton needs no bounds.
END = "\0\0"


class Trie(NamedTuple):
    """Nodes by number: the text of the edge that leads to it, its word's count (0: no word ends here), children by first character."""

    labels: list[str]
    counts: list[int]
    children: list[dict[str, int]]

    def packed(self) -> bytes:
        return zlib.compress(pickle.dumps(tuple(self), pickle.HIGHEST_PROTOCOL), 1)


def unpacked(payload: bytes) -> Trie:
    return Trie(*pickle.loads(zlib.decompress(payload)))


def _shared(one: str, two: str) -> int:
    size = min(len(one), len(two))
    if one[:size] == two[:size]:
        return size
    return next(i for i in range(size) if one[i] != two[i])


def build(words: list[str], counts: list[int]) -> Trie:
    """Words in ascending order become a trie whose edges hold as much text as they can: at most two nodes a word."""
    labels, held, children = [""], [0], [{}]

    def node(label: str, below: dict[str, int]) -> int:
        labels.append(label)
        held.append(0)
        children.append(below)
        return len(labels) - 1

    path, last = [(0, 0)], ""  # nodes on the way to the last word, each with the length of its text
    for word, count in zip(words, counts):
        shared = _shared(last, word)
        while path[-1][1] > shared:
            below, _ = path.pop()
            above, length = path[-1]
            if length < shared:  # the words part inside this edge
                label = labels[below]
                head, labels[below] = label[: shared - length], label[shared - length :]
                middle = node(head, {labels[below][0]: below})
                children[above][head[0]] = middle
                path.append((middle, shared))
        if rest := word[shared:]:
            added = node(rest, {})
            children[path[-1][0]][rest[0]] = added
            path.append((added, len(word)))
        held[path[-1][0]] = count
        last = word
    return Trie(labels, held, children)


def neighbours(trie: Trie, word: str) -> Iterator[tuple[str, int]]:
    """Words of the trie, with counts, at Levenshtein distance exactly one; each once.

    Depth-first over trie and automaton at once. Down the path that agrees with the word, every branch makes the one edit
    that the automaton allows (one character more, another one, one less); after it only the rest of the word is accepted. In a run of
    equal characters the edit is made at its end, so that no two ways lead to the same word.
    """
    labels, counts, children = trie
    size, asked = len(word), word + END

    def rest(node: int, at: int) -> int:
        """The count of the word that goes on from ``node`` with ``word[at:]``."""
        while at < size:
            child = children[node].get(word[at])
            if child is None:
                return 0
            label = labels[child]
            if not word.startswith(label, at):
                return 0
            node, at = child, at + len(label)
        return counts[node]

    def along(child: int, done: int, at: int) -> int:
        """The same from inside the edge to ``child``, of which ``done`` characters are read."""
        label = labels[child]
        if done == len(label):
            return rest(child, at)
        return rest(child, at + len(label) - done) if label[done] == asked[at] and word.startswith(label[done:], at) else 0

    node, k = 0, 0
    while True:
        here, after = asked[k], asked[k + 1]
        if k < size and here != after and (n := rest(node, k + 1)):
            yield word[:k] + word[k + 1 :], n
        for c, child in children[node].items():
            if c == here:
                continue
            label = labels[child]
            if len(label) == 1:
                down = children[child]
                more, other = here in down or k == size, after in down or k + 1 == size
            else:
                more, other = label[1] == here, label[1] == after
            if more and (n := along(child, 1, k)):
                yield word[:k] + c + word[k:], n
            if other and k < size and (n := along(child, 1, k + 1)):
                yield word[:k] + c + word[k + 1 :], n
        child = children[node].get(here)
        if child is None:
            return
        label = labels[child]
        if word.startswith(label, k):
            node, k = child, k + len(label)
            continue
        # The word and the edge part inside it: the edit is made there or nowhere.
        done = _shared(label, word[k : k + len(label)])
        k += done
        if k < size and asked[k] != asked[k + 1] and (n := along(child, done, k + 1)):
            yield word[:k] + word[k + 1 :], n
        if n := along(child, done + 1, k):
            yield word[:k] + label[done] + word[k:], n
        if k < size and (n := along(child, done + 1, k + 1)):
            yield word[:k] + label[done] + word[k + 1 :], n
        return
