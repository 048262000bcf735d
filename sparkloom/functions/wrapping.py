"""Line filling and links in texts, as folds over the pieces of a text, in built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BREAKS = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85  ]"


def lines(text: Column) -> Column:
    """The lines of a text; none after the last line break."""
    parts = F.split(text, _BREAKS)
    return F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


#: Where Python's textwrap may break, with and without hyphens and dashes.
_WHITE, _BLACK = r"[\t\n\x0b\x0c\r ]", r"[^\t\n\x0b\x0c\r ]"
_PUNCTUATION, _LETTER = r"[\w!\"'&.,?]", r"[^\d\W]"
_CHUNK = (
    rf"(?U)({_WHITE}+|(?<={_PUNCTUATION})-{{2,}}(?=\w)"
    rf"|{_BLACK}+?(?:-(?:(?<={_LETTER}{{2}}-)|(?<={_LETTER}-{_LETTER}-))(?={_LETTER}-?{_LETTER})|(?={_WHITE}|\z)|(?<={_PUNCTUATION})(?=-{{2,}}\w)))"
)
_WORD = rf"({_WHITE}+|{_BLACK}+)"


_BLANKS = r"\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _blank(text: Column) -> Column:
    return text.rlike(rf"^[\s{_BLANKS}]*\z")


def _plain(line: Column, width: int, hyphens: bool) -> Column:
    """Whether a line is words of at most ``width`` characters, one space between them, and may break at spaces only."""
    return ~line.rlike(rf"^ | \z|  |[\t\n\x0b\x0c\r{_BLANKS}{'-' if hyphens else ''}]|[^ ]{{{width + 1}}}")


def _pieces(line: Column, width: int) -> Column:
    """The lines that a plain line is filled to: each time as many words as there is room for."""
    more = rf"(?:.{{0,{width - 2}}}[^ ])?" if width > 1 else ""
    return F.regexp_extract_all(line, F.lit(rf"([^ ]{more})(?: |\z)"), 1)


def wordwrap(text: Column, width: int, break_long_words: bool = True, mark: str = "\n", break_on_hyphens: bool = True) -> Column:
    """Each line of a text filled anew to ``width`` characters. The breaks it has stay; white space at new breaks goes."""

    def filled(line: Column) -> Column:
        chunks = F.regexp_extract_all(line, F.lit(_CHUNK if break_on_hyphens else _WORD), 1)
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("tail"), F.lit(True).alias("empty"))
        end = F.aggregate(chunks, start, lambda a, c: _placed(a, c, width, break_long_words, break_on_hyphens))
        return F.array_join(F.aggregate(F.array(end), F.array().cast("array<string>"), lambda _, e: _ended(e)), mark)

    short = lambda line: (F.length(line) <= width) & ~_blank(F.substring(line, -1, 1))  # noqa: E731  nothing to fill
    # most lines are plain, and a fold over chunks takes some ten times as long
    plain = lambda line: _plain(line, width, break_on_hyphens)
    one = lambda line: F.when(short(line), line).when(plain(line), F.array_join(_pieces(line, width), mark)).otherwise(filled(line))
    return F.array_join(F.transform(lines(text), one), mark)


def _line(done: Column, now: Column, tail: Column, empty: Column):
    return F.struct(done.alias("done"), now.alias("now"), tail.alias("tail"), empty.alias("empty"))


def _ended(a: Column) -> Column:
    """The lines with the current one, less a blank chunk at its end; none if nothing is left of it."""
    bare = F.substring(a["now"], F.lit(1), F.length(a["now"]) - a["tail"])
    return F.when(a["empty"] | (bare == ""), a["done"]).otherwise(F.concat(a["done"], F.array(bare)))


def _placed(a: Column, chunk: Column, width: int, break_long: bool, hyphens: bool) -> Column:
    """``done`` lines, the line ``now``, the length of a blank chunk at its ``tail``, and whether it is ``empty``, after one more chunk."""
    size, blank = F.length(chunk), _blank(chunk)
    tail = F.when(blank, size).otherwise(0)
    anew = lambda done: F.when(blank & (F.size(done) > 0), _line(done, F.lit(""), F.lit(0), F.lit(True))).otherwise(_line(done, chunk, tail, F.lit(False)))
    fits = F.length(a["now"]) + size <= width
    if break_long:
        over = _cut(a, chunk, width, hyphens)
    else:  # on a line of its own, if there is anything to see
        own = F.when(blank, F.array().cast("array<string>")).otherwise(F.array(chunk))
        over = _line(F.concat(_ended(a), own), F.lit(""), F.lit(0), F.lit(True))
    return (
        F.when(a["empty"] & blank & (F.size(a["done"]) > 0), a)
        .when(fits, _line(a["done"], F.concat(a["now"], chunk), tail, F.lit(False)))
        .when(size > width, over)
        .otherwise(anew(_ended(a)))
    )


def _cut(a: Column, chunk: Column, width: int, hyphens: bool) -> Column:
    """A chunk longer than a line: as much as there is room for goes on the current one, the rest on lines of its own."""

    def end(rest: Column, room: Column) -> Column:
        if not hyphens:
            return room
        head = F.substring(rest, F.lit(1), room)
        at = F.length(head) - F.instr(F.reverse(head), "-") + 1  # of the last hyphen, from 1
        after = F.contains(head, F.lit("-")) & (at > 1) & F.substring(head, F.lit(1), at - 1).rlike("[^-]") & (F.length(rest) > room)
        return F.when(after, at).otherwise(room)

    def one(s: Column) -> Column:
        room = F.lit(width) - F.length(s["now"])
        n = end(s["rest"], room)
        piece, rest = F.substring(s["rest"], F.lit(1), n), F.substring(s["rest"], n + 1, F.length(s["rest"]))
        # a blank piece goes, and what stood before it stays as it is
        whole = F.when(_blank(piece), s["now"]).otherwise(F.concat(s["now"], piece))
        done = F.when(whole == "", s["done"]).otherwise(F.concat(s["done"], F.array(whole)))
        left = F.when(_blank(rest) & (F.size(done) > 0), "").otherwise(rest)
        return F.struct(done.alias("done"), F.lit("").alias("now"), left.alias("rest"))

    start = F.struct(a["done"].alias("done"), a["now"].alias("now"), chunk.alias("rest"))
    rounds = F.sequence(F.lit(1), F.length(chunk) if hyphens else F.ceil(F.length(chunk) / width).cast("int") + 1)
    cut = F.aggregate(rounds, start, lambda s, _: F.when(F.length(s["rest"]) > width, one(s)).otherwise(s))
    rest = cut["rest"]
    return _line(cut["done"], rest, F.when(_blank(rest), F.length(rest)).otherwise(0), rest == "")


#: What counts as a link and as a mail address.
_HTTP = (
    r"(?iU)^((https?://|www\.)(([\w%-]+\.)+)?([a-z]{2,63}|xn--[\w%]{2,59})|([\w%-]{2,63}\.)+(com|net|int|edu|gov|org|info|mil)"
    r"|(https?://)((([\d]{1,3})(\.[\d]{1,3}){3})|(\[([\da-f]{0,4}:){2}([\da-f]{0,4}:?){1,6}])))(?::[\d]{1,5})?(?:[/?#]\S*)?$"
)
_MAIL = r"(?U)^\S+@\w[\w.-]*\.\w+$"
_OPENING, _CLOSING = r"^(?:[(<]|&lt;)+", r"(?:[)>.,\n]|&gt;)+$"
_PAIRS = (("(", ")"), ("<", ">"), ("&lt;", "&gt;"))


def _times(text: Column, mark: str) -> Column:
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)).cast("int")


def urlize(escaped: Column, limit: int | None = None, rel: str = "", target: str | None = None, schemes: list[str] = ()) -> Column:
    """Web and mail addresses in an escaped text as links."""
    quoted = lambda x: x.replace("&", "&amp;").replace('"', "&#34;").replace("<", "&lt;").replace(">", "&gt;")
    more = (f' rel="{quoted(rel)}"' if rel else "") + (f' target="{quoted(target)}"' if target else "")
    shown = lambda x: x if limit is None else F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit), F.lit("..."))).otherwise(x)

    def link(s: Column) -> Column:
        middle = s["middle"]
        anchor = lambda address, text, extra="": F.concat(F.lit('<a href="'), address, F.lit(f'"{extra}>'), text, F.lit("</a>"))
        address = F.when(middle.startswith("https://") | middle.startswith("http://"), middle).otherwise(F.concat(F.lit("https://"), middle))
        bare = F.substring(middle, F.lit(8), F.length(middle))
        mail = middle.contains("@") & ~middle.startswith("www.") & ~middle.contains(":") & middle.rlike(_MAIL)
        out = F.when(middle.rlike(_HTTP), anchor(address, shown(middle), more)).when(middle.startswith("mailto:") & bare.rlike(_MAIL), anchor(middle, bare))
        out = out.when(mail, anchor(F.concat(F.lit("mailto:"), middle), middle))
        for scheme in schemes:
            out = out.when((middle != scheme) & middle.startswith(scheme), anchor(middle, middle, more))
        return F.concat(s["head"], out.otherwise(middle), s["tail"])

    def word(w: Column) -> Column:
        # most words are neither, and need no taking apart
        may = w.rlike(r"(?i)@|://|www\.|\.(com|net|int|edu|gov|org|info|mil)" + "".join(rf"|\Q{x}\E" for x in schemes))
        parts = F.array(_parts(w))
        for opening, close in _PAIRS:
            parts = F.transform(parts, _balanced(opening, close))
        return F.when(may, F.get(F.transform(parts, link), F.lit(0))).otherwise(w)

    return F.array_join(F.transform(F.regexp_extract_all(escaped, F.lit(r"(?U)(\s+|\S+)"), 1), word), "")


def _parts(w: Column) -> Column:
    """What may be an address, without brackets before it and brackets and stops behind it."""
    head = F.regexp_extract(w, _OPENING, 0)
    rest = F.substring(w, F.length(head) + 1, F.length(w))
    tail = F.regexp_extract(rest, _CLOSING, 0)
    return F.struct(head.alias("head"), F.substring(rest, F.lit(1), F.length(rest) - F.length(tail)).alias("middle"), tail.alias("tail"))


def _balanced(opening: str, close: str) -> Callable[[Column], Column]:
    """Closing brackets go back to an address that has more opening ones."""
    return lambda s: _given_back(s, opening, close)


def _given_back(s: Column, opening: str, close: str) -> Column:
    opened = _times(s["middle"], opening)
    moved = F.when(opened > _times(s["middle"], close), F.least(opened, _times(s["tail"], close))).otherwise(0)
    upto = F.when(moved > 0, F.length(_first(s["tail"], close, moved))).otherwise(0)
    return F.struct(
        s["head"].alias("head"), F.concat(s["middle"], F.substring(s["tail"], F.lit(1), upto)).alias("middle"), F.substring(s["tail"], upto + 1, F.length(s["tail"])).alias("tail")
    )


def _first(text: Column, mark: str, n: Column) -> Column:
    """The text up to and with the n-th mark."""
    return F.concat(F.array_join(F.slice(F.split(text, rf"\Q{mark}\E"), F.lit(1), n), mark), F.lit(mark))
