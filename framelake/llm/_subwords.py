"""Subword ids by the public word-level BPE, word by word.

The tokenizer's rules never look across ASCII white space (its splitting pattern drops white space,
its merges stay inside a split, and its special strings hold none), so a text's ids are its words'
ids in a row. Each worker encodes a word once.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from framelake.llm._words import RaggedLexicon, Words

DEFAULT_VOCABULARY = "word_bpe_49k.json"

#: Stands between words that are encoded together; a word that holds it is encoded alone.
_MARK = "\x01"

#: The public vocabulary's cuts inside a word. Plain words are cut here by the same rule, as it reads for their letters.
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of ASCII without capitals, apostrophes and <, which special strings begin with, and of the accented letters of Latin-1, that no normalising changes.
_PLAIN = re.compile(r"[!-&(-;=-@\[-~à-öø-ÿ]+").fullmatch
_PIECES = re.compile(r"[a-zà-öø-ÿ]+|[0-9]|[^0-9a-zà-öø-ÿ]+").findall

_open: dict[str, RaggedLexicon] = {}


def vocabulary_path(name_or_path: str = DEFAULT_VOCABULARY) -> str:
    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def lexicon(path: str) -> RaggedLexicon:
    if path not in _open:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(vocabulary_path(path))

        mark = tok.encode(_MARK, add_special_tokens=False).ids
        assert len(mark) == 1
        simple = _simple(tok)

        def encode_odd(plain: list[str]) -> list[np.ndarray]:
            # Many words in one call, a mark between them: a call for each word costs twice the time.
            odd = {i: tok.encode(w, add_special_tokens=False).ids for i, w in enumerate(plain) if _MARK in w}
            texts = [f" {_MARK} ".join("" if _MARK in w else w for w in plain[i : i + 1000]) + f" {_MARK}" for i in range(0, len(plain), 1000)]
            lists = [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
            ids = np.concatenate([np.array(x, np.uint32) for x in lists]) if lists else np.zeros(0, np.uint32)
            ends = np.flatnonzero(ids == mark[0])
            length = np.diff(ends, prepend=-1) - 1
            flat = ids[ids != mark[0]]
            if odd:
                pieces = np.split(flat, np.cumsum(length)[:-1])
                for i, x in odd.items():
                    pieces[i] = np.array(x, np.uint32)
                length, flat = np.array([len(x) for x in pieces]), np.concatenate(pieces)
            return [length, flat]

        def encode(words: list[bytes]) -> list[np.ndarray]:
            plain = [w.decode("utf-8", "replace") for w in words]
            easy = np.array([simple is not None and _PLAIN(w) is not None for w in plain], bool)
            which = np.flatnonzero(easy)
            length, flat = encode_odd([plain[i] for i in np.flatnonzero(~easy)])
            if len(which):
                some_length, some = _encode_simple(*simple, [plain[i] for i in which])
                both = np.empty(len(plain), np.int64)
                both[which], both[~easy] = some_length, length
                of_easy = np.repeat(easy, both)
                whole = np.empty(len(of_easy), np.uint32)
                whole[of_easy], whole[~of_easy] = some, flat
                length, flat = both, whole
            return [(np.cumsum(length) - length).astype(np.int32), length.astype(np.int32), flat]

        _open[path] = RaggedLexicon(encode)
    return _open[path]


def _simple(tok):
    """(the tokenizer for words that are cut already, which ids end a piece), where the vocabulary's rules are the public one's; else None."""
    from tokenizers import Tokenizer, pre_tokenizers

    rules = json.loads(tok.pre_tokenizer.__getstate__()) if tok.pre_tokenizer else {}
    cuts = rules.get("pretokenizers") or [{}]
    if (cuts[0].get("pattern") or {}).get("Regex") != _CUTS or [c["type"] for c in cuts] != ["Split", "ByteLevel"] or getattr(tok.model, "end_of_word_suffix", None) != "</w>":
        return None
    cut = Tokenizer(tok.model)  # the same merges, held once
    cut.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return cut, np.array([(tok.id_to_token(i) or "").endswith("</w>") for i in range(tok.get_vocab_size())])


def _encode_simple(tok, ends: np.ndarray, plain: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids of each word, ids of all): a piece of a word ends with the one id that can only end one."""
    pieces = [_PIECES(w) for w in plain]
    texts = [" ".join([" ".join(p) for p in pieces[i : i + 1000]]) for i in range(0, len(pieces), 1000)]
    ids = np.concatenate([np.array(e.ids, np.uint32) for e in tok.encode_batch_fast(texts, add_special_tokens=False)])
    last = np.flatnonzero(ends[ids])[np.cumsum([len(p) for p in pieces]) - 1]
    assert last[-1] == len(ids) - 1 and np.count_nonzero(ends[ids]) == sum(len(p) for p in pieces)
    return np.diff(last, prepend=-1), ids


def encode(texts: pa.Array | Words, path: str = DEFAULT_VOCABULARY, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, offsets of each text's ids); texts may be words already cut."""
    words = texts if isinstance(texts, Words) else Words(texts, lower=lower)
    ids, length = lexicon(path).spread(words)
    ends = np.concatenate([[0], np.cumsum(length)])
    return ids, ends[words.first]
