"""Memo of encoded words for ``tokenizers`` BPE files.

Distinct words are encoded once per worker.  Words of Latin letters and trailing ASCII marks (letters and
marks are separate matches of the split patterns) are merged in one ``tiktoken`` call per batch over the
file's own vocabulary; every other word goes through the tokenizer itself.

Why the merges agree: ``tiktoken`` merges any neighbours whose concatenation is in the vocabulary, least id
first; the file merges listed pairs, least first.  They differ only if some token can arise from another
pair than its listed one.  Inside the span of a token T nothing but T's own bytes takes part, so that needs
a T that the file's model does not build from its own text: such tokens are found when the file is loaded
(each is put through the model) and left out, as are tokens whose id is out of merge order.
"""

from __future__ import annotations

import functools
import re
import string

import numpy as np

LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")     # letters that every normaliser step keeps apart
#: white space of the split patterns, as the inside of a character class
WS = "\\t-\\r \\x85\\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
NOT_SPACE = tuple(map(chr, range(0x1C, 0x20)))    # str.split() takes these as white space, the patterns do not


def load(path: str):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def byte_alphabet() -> list[str]:
    """The character that byte-level BPE uses for each byte: printable bytes are themselves, the others
    follow in order from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Merger:
    """Ids of many words in one call.  A word ends with a line feed: the model's end-of-word suffix if it
    has one, else a token of its own that is cut off."""

    def __init__(self, tok):
        import tiktoken
        suffix = tok.model.end_of_word_suffix or ""
        back = {c: b for b, c in enumerate(byte_alphabet())}
        special = {t.content for t in tok.get_added_tokens_decoder().values()}
        feed = 10
        ranks: dict[bytes, int] = {}
        self.ends = np.zeros(tok.get_vocab_size(), bool)
        for token, i in sorted(tok.get_vocab().items(), key=lambda x: x[1]):
            if token in special:
                continue
            last = bool(suffix) and token.endswith(suffix)
            body = token.removesuffix(suffix) if last else token
            raw = bytes(back[c] for c in body)
            if feed in raw and len(raw) + last > 1:
                continue                                  # no word holds a line feed
            if suffix and not last and len(raw) > 1:      # the model closes its input: built as part of a longer word
                built = len(tok.model.tokenize(body + "\x00")) == 0 or self._builds(tok, body, i)
            else:
                built = [t.id for t in tok.model.tokenize(body)] == [i] or len(raw) == 1
            if built:
                ranks[raw + (b"\n" if last else b"")] = i
                self.ends[i] = last or raw == b"\n"
        self.suffix = suffix
        self.enc = tiktoken.Encoding("words", pat_str="[^\n]+\n" if suffix else "[^\n]+|\n", mergeable_ranks=ranks,
                                     special_tokens={})

    @staticmethod
    def _builds(tok, body: str, i: int) -> bool:
        # a token without the suffix: before some byte that leaves it whole (any of the vocabulary's do)
        return any(tok.model.tokenize(body + c)[0].id == i for c in "!~0zq")

    def __call__(self, words: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word."""
        if not words:
            return []
        ids = np.array(self.enc.encode_ordinary("\n".join(words) + "\n"), dtype="<u4")
        stop = np.flatnonzero(self.ends[ids]) + 1
        cut = 0 if self.suffix else 4
        raw, at = ids.tobytes(), (stop * 4).tolist()
        return [raw[a:b - cut] for a, b in zip([0, *at], at)]


@functools.lru_cache(maxsize=2)
def model(path: str) -> tuple:
    """Tokenizer and merger of a file, loaded once per worker process (both are only read)."""
    tok = load(path)
    return tok, Merger(tok)


class Memo:
    """word -> ids as bytes (4 each; or their number, ``count``), in ``known`` after ``learn``.  ``lower``: the tokenizer lowers and drops
    white space; else one leading space belongs to a word.  An over-full memo starts anew between batches;
    its content never changes a result."""

    def __init__(self, path: str, lower: bool, limit: int, count: bool = False):
        self.lower, self.limit, self.count, self.known = lower, limit, count, {}
        self.tok, self.merge = model(path)

    def _whole(self, word: str) -> bytes | int:
        ids = self.tok.encode(word, add_special_tokens=False).ids
        return len(ids) if self.count else np.array(ids, "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        known, lower = self.known, self.lower
        if len(known) > self.limit:
            known.clear()
        plan, cores, marks = [], set(), string.punctuation
        for w in words.difference(known):
            core = w.rstrip(marks)
            body = core[1:] if not lower and core[:1] == " " else core
            if body.isascii() and body.isalpha() or LATIN.fullmatch(body):
                name = core.lower() if lower else core
                cores.add(name)
                if name != w:
                    plan.append((w, name, w[len(core):]))
            else:
                known[w] = self._whole(w)
        new = list(cores.difference(known))
        merged = self.merge(new)
        known.update(zip(new, [len(x) // 4 for x in merged] if self.count else merged))
        for w, name, tail in plan:
            if tail and tail not in known:
                known[tail] = self._whole(tail)
            known[w] = known[name] + known[tail] if tail else known[name]
