"""Token ids of whole texts, with each distinct word encoded once per Python worker.

The tokenizer's pre-tokenizer never lets a token cross white space, so a text's ids are the ids of
its white-space separated words in order. Words of plain letters, digits and punctuation skip the
normaliser: lower-casing them and splitting them by the pre-tokenizer's pattern is all it does to
them. Every other word, and every word that holds a special token's string, goes through the whole
tokenizer. Tests hold both ways against ``Tokenizer.encode`` of the whole text.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Words and pieces kept per worker before a table starts anew: some 300 MB. A forgotten word costs
#: little while its pieces are known, so that table is the larger one.
WORDS_KEPT, PIECES_KEPT = 500_000, 1_000_000

# Characters that normal form C and lower-casing leave single, and the pre-tokenizer's pattern over them.
PLAIN, ALL_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*"), re.compile(r"[ -~À-ÖØ-öø-ÿ]*")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+| ")

#: The id that ends every document.
END_ID = 1


class WordEncoder:
    """Encodes texts to little-endian unsigned ids, two bytes each where the vocabulary allows it."""

    def __init__(self, path: str, words_kept: int = WORDS_KEPT):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.specials = [t["content"] for t in json.load(open(path, encoding="utf-8"))["added_tokens"]]
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.whole.get_vocab_size()
        self.ends_word = np.array([(self.whole.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.words_kept = words_kept

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, without the end id."""
        split = [t.encode().split() for t in texts]  # at ASCII white space only
        if len(self.words) > self.words_kept:
            self.words = {}
        if len(self.pieces) > PIECES_KEPT:
            self.pieces = {}
        special = any(s in t for t in texts for s in self.specials)
        self._learn(set().union(*split).difference(self.words), special)
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def _learn(self, words: set[bytes], special: bool) -> None:
        if not words:
            return
        raw = list(words)
        whole = b" ".join(raw).decode()
        odd: dict[bytes, str] = {}
        if special or not ALL_PLAIN.fullmatch(whole):
            both = list(zip(raw, whole.split(" ")))
            odd = {word: text for word, text in both if not PLAIN.fullmatch(text) or (special and any(s in text for s in self.specials))}
            raw, whole = [word for word in raw if word not in odd], " ".join([text for word, text in both if word not in odd])
        # All plain words are split in one go; a blank, which no piece holds, stands between words.
        found = PIECES.findall(whole.lower()) if raw else []
        known, gap = self.pieces, np.array([-1]).astype(self.dtype)
        self._learn_pieces(list(set(found).difference(known, " ")))
        known[" "] = gap.tobytes()
        joined = b"".join(map(known.__getitem__, found))
        cuts = (np.flatnonzero(np.frombuffer(joined, self.dtype) == gap[0]) * self.dtype.itemsize).tolist()
        width = self.dtype.itemsize
        if raw:
            starts = [0, *[c + width for c in cuts]]
            self.words.update(zip(raw, [joined[a:b] for a, b in zip(starts, [*cuts, len(joined)])]))
        for word, found_ids in zip(odd, self.whole.encode_batch(list(odd.values()), add_special_tokens=False)):
            self.words[word] = np.array(found_ids.ids, dtype=self.dtype).tobytes()

    def _learn_pieces(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 1000):
            part = pieces[at : at + 1000]
            ids = np.array(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(part):  # a vocabulary without word ends: one by one
                for piece in part:
                    self.pieces[piece] = np.array(self.bare.encode(piece, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
                continue
            raw, width, start = ids.tobytes(), self.dtype.itemsize, 0
            for piece, end in zip(part, ends.tolist()):
                self.pieces[piece] = raw[start * width : end * width]
                start = end


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str, words_kept: int = WORDS_KEPT) -> WordEncoder:
    """One encoder per worker process, kept across its tasks."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = WordEncoder(path)
    _encoders[path].words_kept = words_kept
    return _encoders[path]


def forget_words() -> None:
    """Drop the tables of this worker process; work that encodes nothing has their memory."""
    for kept in _encoders.values():
        kept.words, kept.pieces = {}, {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
