"""Cutting texts where public tokenizers never merge, so that equal pieces are encoded once.

A text is cut before each single space that stands between a character other
than a space and one that is not white space. A byte-level BPE's splitting pattern always ends a
token there, and a sentencepiece model has no piece that goes on past such a
space; so a text's ids are those of its chunks, one after the other. What a
chunk costs is paid once for each worker while the chunk is remembered.
"""

from __future__ import annotations

import importlib.util
import os
import re

#: Where the tokenizers' files are; the setting spark.tokenlake.tokenizers names another folder.
FOLDER = "/opt/tokenizers"
_BLANK_AHEAD = re.compile(r" (?:\s|[\u180e\u200b\ufeff]|$)")
# characters that some patterns take for white space are never cut before
_CUT = re.compile(r"(?<=[^ ]) (?=[^\s\u180e\u200b\ufeff])")


def path(folder: str, name: str) -> str:
    """A tokenizer's file, by the folder's own path() where it has one."""
    at = os.path.join(folder, "__init__.py")
    if not os.path.exists(at):
        return os.path.join(folder, name)
    spec = importlib.util.spec_from_file_location("public_tokenizers", at)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.path(name)


def byte_tokenizer(folder: str, specials_are_text: bool):
    """The byte-level BPE of the tokenizers library, for one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path(folder, "byte_bpe_50k.json"))
    made.encode_special_tokens = specials_are_text
    return made


def byte_entries(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level BPE: printable Latin-1 stands for itself, all other bytes for U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    back = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(own)))}
    out = [b""] * tokenizer.get_vocab_size()
    for entry, i in tokenizer.get_vocab().items():
        out[i] = bytes(back[c] for c in entry) if all(c in back for c in entry) else entry.encode()
    return out


def chunks(text: str) -> list[str]:
    """Chunks of a text that is not empty, without the space that each but the first begins with."""
    return _CUT.split(text) if text[0] == " " or _BLANK_AHEAD.search(text) else text.split(" ")


def joinable(chunk: str) -> bool:
    """Whether chunks around it may be joined by spaces and encoded in one call."""
    return bool(chunk) and chunk[-1] != " " and not chunk[0].isspace() and chunk[0] not in "\u180e\u200b\ufeff"
