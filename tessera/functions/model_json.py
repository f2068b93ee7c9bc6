"""JSON that language models answer with: in prose or fences, with loose quotes and commas, or cut off."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.IGNORECASE | re.DOTALL)
#: Names of constants, of JSON and of Python.
NAMES = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None}
QUOTES = {'"': '"', "'": "'", "\u201c": "\u201d", "\u2018": "\u2019"}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
END = object()


def candidates(content: str) -> Iterator[str]:
    """Each once: the whole, what stands in fences, the outermost object, the outermost array (to the end, if it isn't closed)."""
    found = [content, *FENCE.findall(content)]
    for a, b in ("{}", "[]"):
        start, end = content.find(a), content.rfind(b)
        if start >= 0:
            found.append(content[start : end + 1] if end > start else content[start:])
    yield from dict.fromkeys(x.strip() for x in found if x.strip())


class Reader:
    """A reader that takes what it finds for JSON and closes what was left open: a stack of containers, no recursion."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def skip(self) -> str:
        """Past white space and comments; the next character, empty at the end."""
        while self.at < len(self.text):
            if self.text[self.at].isspace():
                self.at += 1
            elif self.text.startswith("//", self.at) or self.text.startswith("#", self.at):
                self.at = (self.text.find("\n", self.at) + 1) or len(self.text)
            elif self.text.startswith("/*", self.at):
                self.at = (self.text.find("*/", self.at) + 2) if "*/" in self.text[self.at :] else len(self.text)
            else:
                return self.text[self.at]
        return ""

    def string(self) -> str:
        """A quoted string; it ends at its quote, or where the text does."""
        close, out = QUOTES[self.text[self.at]], []
        self.at += 1
        while self.at < len(self.text) and self.text[self.at] != close:
            c = self.text[self.at]
            self.at += 1
            if c != "\\" or self.at >= len(self.text):
                out.append(c if c != "\\" else "")
                continue
            e = self.text[self.at]
            self.at += 1
            code = self.text[self.at : self.at + 4]
            if e == "u" and re.fullmatch("[0-9a-fA-F]{4}", code):
                out.append(chr(int(code, 16)))
                self.at += 4
            else:
                out.append(ESCAPES.get(e, e))
        self.at += 1
        return re.sub("[\ud800-\udbff][\udc00-\udfff]", lambda m: m[0].encode("utf-16", "surrogatepass").decode("utf-16"), "".join(out))

    def bare(self, stop: str) -> str:
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in stop:
            self.at += 1
        return self.text[start : self.at].strip()

    def scalar(self):
        if self.text[self.at] in QUOTES:
            return self.string()
        word = re.split(r"\s+(?://|#|/\*)", self.bare(",:]}\n"))[0]
        if word in NAMES:
            return NAMES[word]
        if re.fullmatch(r"-?\d+", word):
            return int(word)
        try:
            return float(word) if re.match(r"-?[\d.]", word) else word
        except ValueError:
            return word

    def value(self):
        """The first object or array of the text; END if there is none."""
        open_at = [i for i in (self.text.find("{"), self.text.find("[")) if i >= 0]
        if not open_at:
            return END
        self.at = min(open_at)
        top: list = []
        stack: list = [top]
        key = END  # of the object on top of the stack, while it waits for its value

        def put(v) -> None:
            nonlocal key
            if isinstance(stack[-1], dict):
                if key is not END:
                    stack[-1][key] = v
                key = END
            else:
                stack[-1].append(v)

        while c := self.skip():
            if c in "{[":
                new = {} if c == "{" else []
                put(new)
                stack.append(new)
                key = END
                self.at += 1
            elif c in "}]":
                if isinstance(stack[-1], dict) and key is not END:
                    put(None)
                kind = dict if c == "}" else list
                self.at += 1
                if any(isinstance(s, kind) for s in stack[1:]):  # what is open inside is closed too
                    while True:
                        if isinstance(stack.pop(), kind):
                            break
                key = END
                if len(stack) == 1:
                    return top[0]
            elif c in ",:`":
                self.at += 1
            elif isinstance(stack[-1], dict) and key is END:
                k = self.string() if c in QUOTES else self.bare(",:]}\n")
                if self.skip() == ":":
                    key = k
                elif not k:
                    self.at += 1
            else:
                before = self.at
                put(self.scalar())
                self.at += self.at == before
        if isinstance(stack[-1], dict) and key is not END:
            put(None)
        return top[0]


def parsed(content: str | None):
    """The value of a model's answer: of the first candidate that is JSON, else of the first that can be read as such; END if there is no object or array in it."""
    content = (content or "").strip()
    if "{" not in content and "[" not in content:
        return END
    for c in candidates(content):
        try:
            return json.loads(c)
        except ValueError:
            pass
    return next((v for c in candidates(content) if (v := Reader(c).value()) is not END), END)


def json_text(content: str) -> str | None:
    v = parsed(content)
    return None if v is END else json.dumps(v, ensure_ascii=False)


def model_json(text: Column) -> Column:
    """A model's answer as JSON text, null where it has none: Arrow batches of short texts."""
    return F.pandas_udf(lambda texts: texts.map(json_text, na_action="ignore").astype("object"), "string")(text)
