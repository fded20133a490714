"""Token ids of whole texts, made by a public tokenizer.

Words recur, so each space-separated piece of text is given to the tokenizers library once and its ids
are remembered. That is exact: in neither vocabulary does a token reach over a single space between
other characters, from the left. Texts with a space next to other white space are encoded whole.

The pieces of a batch of texts are numbered by Arrow, so a piece is looked up once a batch. New pieces of
letters, digits, plain marks and single line ends are cut where the kind of character changes, as both
vocabularies do, and each different word goes to the library's model once; other pieces go through all of the library.
"""

from __future__ import annotations

import os
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from talentspark.llm.common import ranges

KEPT_PIECES = 400_000
JOINED = 100  # new pieces per encoded line
TOGETHER = 64  # the library's results are ten times the ids
MARK = "<|startoftext|>"
# neither white space nor the characters of a special token
SIMPLE = re.compile(r"[^\s<>|]+\Z").match
# white space as Python's \s has it, for Arrow
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BESIDE = f"{SPACE} | {SPACE}"
# letters that no neighbour changes; marks without the apostrophe of short forms and what special tokens are made of
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:;=?@\[-`{}~"
PLAIN = re.compile(rf"[{LETTERS}0-9{MARKS}]+(?:\n[{LETTERS}0-9{MARKS}]+)*").fullmatch
WORDS = re.compile(rf"[{LETTERS}]+|[0-9]+|[{MARKS}]+|\n").findall


class Numbers(dict):
    """A string's number, in order of appearance."""

    def __missing__(self, name: str) -> int:
        value = self[name] = len(self)
        return value


class Known:
    """The ids of strings. ``forget`` keeps those that came more than once since the last time, at most half of ``kept``."""

    def __init__(self, kept: int):
        self.kept, self.number, self.ids = kept, Numbers(), np.zeros(0, np.uint16)
        self.start = self.size = self.uses = np.zeros(0, np.int64)

    def forget(self) -> None:
        if len(self.number) <= self.kept:
            return
        kept = np.flatnonzero(self.uses > 1)
        kept = kept[np.argsort(-self.uses[kept], kind="stable")][:self.kept // 2]
        names = list(self.number)
        self.number = Numbers((names[k], i) for i, k in enumerate(kept.tolist()))
        self.ids, self.size = self.ids[ranges(self.start[kept], self.size[kept])], self.size[kept]
        self.start, self.uses = np.cumsum(self.size) - self.size, np.zeros(len(kept), np.int64)

    def numbers(self, names: list[str]) -> tuple[np.ndarray, list[str]]:
        """The numbers of ``names``, and the new ones among them by number, whose ids have to be added."""
        found = np.fromiter(map(self.number.__getitem__, names), np.int64, len(names))
        return found, list(islice(reversed(self.number), len(self.number) - len(self.size)))[::-1]

    def add(self, order: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """The ids of the new names, which come in this ``order``."""
        start, size = np.zeros((2, len(sizes)), np.int64)
        start[order], size[order] = len(self.ids) + np.cumsum(sizes) - sizes, sizes
        self.start, self.size, self.ids = np.r_[self.start, start], np.r_[self.size, size], np.r_[self.ids, ids]
        self.uses = np.r_[self.uses, np.zeros(len(sizes), np.int64)]

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all, one after the other, and how many each has."""
        sizes = self.size[numbers]
        return self.ids[ranges(self.start[numbers], sizes)], sizes


class Encoder:
    """``leading``: whether the space before a word belongs to its token."""

    def __init__(self, path: str, leading: bool, kept: int = KEPT_PIECES):
        # a task has one core; the library would start a thread for each core of the machine
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.leading = Tokenizer.from_file(path), leading
        # in a byte-level vocabulary \u0120 stands for the space
        size = self.tokenizer.get_vocab_size()
        self.begins = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.mark = self.tokenizer.token_to_id(MARK)
        self.pieces, self.words = Known(kept), Known(kept)
        self.tokenize = self.tokenizer.model.tokenize
        letters = [c for c in map(chr, range(0x100)) if re.match(f"[{LETTERS}]", c)] + [" "] * leading
        self.forms = str.maketrans({c: self._form(c) for c in letters})

    @property
    def number(self) -> dict[str, int]:
        """The remembered pieces."""
        return self.pieces.number

    def _form(self, char: str) -> str:
        """What the model sees of a character."""
        if self.tokenizer.normalizer is not None:
            char = self.tokenizer.normalizer.normalize_str(char)
        return "".join(x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(char))

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        parts = (texts[k:k + TOGETHER] for k in range(0, len(texts), TOGETHER))
        return [np.array(e.ids, np.uint16) for p in parts for e in self.tokenizer.encode_batch_fast(p, add_special_tokens=False)]

    def _learn_words(self, words: list[str]) -> None:
        """Words are of one kind of character; the model takes those of letters as they are."""
        spelled = np.fromiter((w[-1].isalpha() for w in words), bool, len(words))
        letters = [w for w, s in zip(words, spelled.tolist(), strict=True) if s]
        rest = self._whole([w for w, s in zip(words, spelled.tolist(), strict=True) if not s])
        ids, sizes = [], []
        for form in "\n".join(letters).translate(self.forms).split("\n") if letters else []:
            found = [t.id for t in self.tokenize(form)]
            ids += found
            sizes.append(len(found))
        order = np.r_[np.flatnonzero(spelled), np.flatnonzero(~spelled)]
        self.words.add(order, np.concatenate([np.array(ids, np.uint16), *rest]), np.array(sizes + list(map(len, rest)), np.int64))

    def _plain(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain pieces, word by word, and how many each has."""
        self.words.forget()
        cut, words = [], []
        for p in pieces:
            found = WORDS(p)
            if self.leading:
                found[0] = " " + found[0]
            cut.append(len(found))
            words += found
        at, fresh = self.words.numbers(words)
        self._learn_words(fresh)
        self.words.uses += np.bincount(at, minlength=len(self.words.uses))
        ids, sizes = self.words.of(at)
        return ids, np.diff(np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(np.array(cut, np.int64))]])

    def _learn(self, pieces: list[str]) -> None:
        """Add new pieces: plain ones by their words, other simple ones as many in one line of text, which is cut at
        the tokens that begin a piece."""
        plain, joined, whole = places = [], [], []
        for k, p in enumerate(pieces):
            (plain if PLAIN(p) else joined if SIMPLE(p) else whole).append(k)
        found, size = self._plain([pieces[k] for k in plain])
        ids, sizes = [found], [size]
        lines = [[pieces[j] for j in joined[k:k + JOINED]] for k in range(0, len(joined), JOINED)]
        for line, found in zip(lines, self._whole([" " + " ".join(x) if self.leading else f" {MARK} ".join(x) for x in lines]), strict=True):
            if self.leading:
                first = np.flatnonzero(self.begins[found])
                sizes.append(np.diff(np.r_[first, len(found)]))
            else:
                border = np.flatnonzero(found == self.mark)
                sizes.append(np.diff(np.r_[-1, border, len(found)]) - 1)
                found = found[found != self.mark]
            if len(sizes[-1]) != len(line):
                raise ValueError("a new piece was not recognised by its first token")
            ids.append(found)
        rest = self._whole([" " * self.leading + pieces[k] for k in whole])
        sizes.append(np.fromiter(map(len, rest), np.int64, len(rest)))
        self.pieces.add(np.concatenate([np.array(x, np.int64) for x in places]), np.concatenate(ids + rest), np.concatenate(sizes))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without any end token."""
        self.pieces.forget()
        out: list[np.ndarray | None] = [None] * len(texts)
        if self.leading:
            odd = np.flatnonzero(pc.match_substring_regex(pa.array(texts, pa.large_string()), BESIDE).to_numpy(zero_copy_only=False)).tolist()
            for i, ids in zip(odd, self._whole([texts[i] for i in odd]), strict=True):
                out[i] = ids
        plain = [i for i in range(len(texts)) if out[i] is None]
        if self.leading:
            # the first piece of a text has no space before it; a text without any has no other piece
            split = [texts[i].partition(" ") for i in plain]
            heads, rests = self._whole([s[0] for s in split]), [s[2] if s[1] else None for s in split]
        else:
            heads, rests = None, [texts[i] for i in plain]
        split = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        names, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        at, fresh = self.pieces.numbers(names)
        self._learn(fresh)
        self.pieces.uses[at] += np.bincount(which, minlength=len(at))
        ids, sizes = self.pieces.of(at[which])
        ends = np.r_[0, np.cumsum(sizes)][np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False))]
        begin = 0
        for k, (i, end) in enumerate(zip(plain, ends.tolist(), strict=True)):
            own = ids[begin:end]
            out[i] = np.concatenate([heads[k], own]) if heads and len(heads[k]) else own
            begin = end
        return out
