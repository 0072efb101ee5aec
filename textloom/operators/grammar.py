"""Two query grammars, compiled to Column predicates and DataFrame plans.

The boolean grammar tests one text: words, "phrases", prefix*, NOT, AND (also implied), OR (loosest), parentheses;
operators in any case. The proximity grammar finds spans. Its operators are, from tight to loose, OR, /n, /s, /p, NOT
and AND (also implied), all left-associative; -term and -"phrase" stand for NOT; EXACT(...) and * are literal; other
words match any form with the same fold. Both are read by one parser from a table of binding strengths.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CORPUS_WORD, fold, unaccent
from ..sources.scratch import written


@dataclass(frozen=True)
class Node:
    op: str  # TERM, AND, OR, NOT, NEAR
    args: tuple = ()
    text: str = ""
    kind: str = ""  # of a term: word, phrase, prefix, exact; of NEAR: n, s, p
    distance: int = 0
    negated: bool = False  # NEAR NOT


class Syntax(ValueError):
    """A query that the grammar does not accept."""


@dataclass(frozen=True)
class Token:
    kind: str  # TERM, NEAR, AND, OR, NOT, NEG, ( or )
    term: Node | None = None
    near: str = ""  # n, s or p
    distance: int = 0


class Parser:
    """Reads tokens by binding strength. Operands that stand side by side are joined by AND."""

    def __init__(self, tokens: list[Token], strength: dict[str, int], join):
        self.tokens, self.strength, self.join, self.at = tokens, strength, join, 0

    def tree(self) -> Node:
        if not self.tokens:
            raise Syntax("the query is empty")
        out = self.climb(0)
        if self.at < len(self.tokens):
            raise Syntax("a parenthesis is closed twice")
        return out

    def operator(self) -> Token | None:
        """The operator at this place; an implied AND takes no token."""
        if self.at == len(self.tokens) or self.tokens[self.at].kind == ")":
            return None
        here = self.tokens[self.at]
        return here if self.strength.get(here.near or here.kind) is not None else Token("AND")

    def climb(self, least: int) -> Node:
        left = self.operand()
        while (op := self.operator()) and self.strength[op.near or op.kind] >= least:
            self.at += op is self.tokens[self.at]
            left = self.join(op, left, self.climb(self.strength[op.near or op.kind] + 1))
        return left

    def operand(self) -> Node:
        if self.at == len(self.tokens):
            raise Syntax("an operand is missing")
        here = self.tokens[self.at]
        self.at += 1
        if here.kind == "TERM":
            return here.term
        if here.kind in ("NOT", "NEG"):
            return Node("NOT", (self.operand(),))
        if here.kind != "(":
            raise Syntax("a word or a quoted phrase is expected")
        inner = self.climb(0)
        if self.at == len(self.tokens) or self.tokens[self.at].kind != ")":
            raise Syntax("a parenthesis is open")
        self.at += 1
        return inner


_PIECES = regex.compile(r"""(?P<quoted>"[^"]*")|(?P<open>")|(?P<paren>[()])|(?P<bare>[^\s()"]+)""")


def _pieces(query: str):
    """(kind, text) of quoted phrases, parentheses and bare words."""
    for m in _PIECES.finditer(query):
        if m.lastgroup == "open":
            raise Syntax("a quotation mark is open")
        yield m.lastgroup, m[0]


# The boolean grammar.


def compatible(text: str) -> str:
    """A text as the boolean grammar compares it: compatibility composition, lower case."""
    return unicodedata.normalize("NFKC", text).lower()


def _boolean_term(kind: str, text: str) -> Node:
    if kind == "quoted":
        body = " ".join(compatible(text[1:-1]).split())
        if not body:
            raise Syntax("a quoted phrase is empty")
    else:
        body = compatible(text)
        if "*" in body[:-1]:
            raise Syntax("* stands at the end of a word only")
    prefix = kind == "bare" and body.endswith("*")
    parts = regex.findall(CORPUS_WORD, body.rstrip("*") if prefix else body)
    if not parts:
        raise Syntax(f"{text!r} has no letter or digit")
    if kind == "quoted" or len(parts) > 1:
        return Node("TERM", text=body, kind="phrase")
    return Node("TERM", text=parts[0], kind="prefix" if prefix else "word")


def parse_boolean(query: str) -> Node:
    tokens = []
    for kind, text in _pieces(query):
        if kind == "paren" or kind == "bare" and text.upper() in ("AND", "OR", "NOT"):
            tokens.append(Token(text.upper()))
        else:
            tokens.append(Token("TERM", _boolean_term(kind, text)))

    def join(op: Token, left: Node, right: Node) -> Node:
        same = left.args if left.op == op.kind else (left,)
        return Node(op.kind, (*same, right))

    return Parser(tokens, {"OR": 0, "AND": 1}, join).tree()


def matches(tree: Node, text: Column, words: Column) -> Column:
    """Whether a text satisfies the tree; words are its lower-case words, text is lower case. Texts in compatibility forms
    go through functions.text.corpus_form first, as queries do (see boolean_search)."""
    if tree.op == "TERM":
        if tree.kind == "word":
            return F.array_contains(words, tree.text)
        if tree.kind == "prefix":
            return F.exists(words, lambda w: F.startswith(w, F.lit(tree.text)))
        return F.contains(text, F.lit(tree.text))
    parts = [matches(a, text, words) for a in tree.args]
    if tree.op == "NOT":
        return ~parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if tree.op == "AND" else out | p
    return out


def candidate_rows(tree: Node, postings: DataFrame, rows: DataFrame, key: str) -> DataFrame | None:
    """Rows that an inverted index (term, key) cannot rule out; None stands for all of them, as under a NOT."""
    if tree.op == "TERM":
        if tree.kind == "word":
            return postings.where(F.col("term") == tree.text).select(key).distinct()
        if tree.kind == "prefix":
            return postings.where(F.col("term").startswith(tree.text)).select(key).distinct()
        parts = [Node("TERM", text=w, kind="word") for w in regex.findall(CORPUS_WORD, tree.text)][1:-1]
        return candidate_rows(Node("AND", tuple(parts)), postings, rows, key) if parts else None
    if tree.op == "NOT":
        return None
    sets = [candidate_rows(a, postings, rows, key) for a in tree.args]
    if tree.op == "AND":
        sets = [s for s in sets if s is not None]
        out = sets[0] if sets else None
        for s in sets[1:]:
            out = out.intersect(s)
        return out
    if any(s is None for s in sets):
        return None
    out = sets[0]
    for s in sets[1:]:
        out = out.union(s)
    return out.distinct()


def boolean_search(texts: DataFrame, query: str, text: str = "text", words: str = "words") -> DataFrame:
    """Rows whose text and words, lower-case and composed as `compatible` does it, satisfy the query."""
    return texts.where(matches(parse_boolean(query), F.lower(F.col(text)), F.col(words)))


def is_ranked(query: str) -> bool:
    """Whether a query is ranked by its words: no token of it is anything but a plain word. Small and/or are words here."""
    try:
        tokens = _proximity_tokens(" ".join(w for w in query.split() if w not in ("and", "or")))
    except Syntax:
        return False
    plain = all(t.kind == "TERM" and t.term.kind == "word" for t in tokens)
    return plain and any(regex.search(r"[\p{L}\p{N}]", t.term.text) for t in tokens)


# The proximity grammar.


def _proximity_term(text: str, quoted: bool = False, exact: bool = False) -> Node:
    body = text.strip()
    if not body:
        raise Syntax("EXACT( ) is empty" if exact else "a quoted phrase is empty")
    if exact or quoted:
        return Node("TERM", text=body.lower(), kind="exact" if exact else "phrase")
    if body.startswith("/"):
        raise Syntax("/p, /s or a number of words such as /5 is expected")
    prefix = body.endswith("*")
    stem = body[:-1] if prefix else body
    if not stem or "*" in stem:
        raise Syntax("* stands after a word only")
    return Node("TERM", text=stem.lower(), kind="prefix" if prefix else "word")


def _proximity_tokens(query: str) -> list[Token]:
    tokens = []
    rest = query.replace("“", '"').replace("”", '"')
    while rest := rest.lstrip():
        exact = re.match(r"exact\(([^)]*)(\))?", rest, re.I)
        if exact:
            if not exact[2]:
                raise Syntax("the parenthesis of EXACT( is open")
            tokens.append(Token("TERM", _proximity_term(exact[1], exact=True)))
            rest = rest[exact.end() :]
            continue
        if rest[0] == "-" and len(rest) > 1 and not rest[1].isspace():
            tokens.append(Token("NEG"))
            rest = rest[1:]
            continue
        kind, text = next(_pieces(rest))
        rest = rest[len(text) :]
        near = re.fullmatch(r"/(\d{1,3}|[sp])", text, re.I)
        if near:
            counted = near[1].isdigit()
            tokens.append(Token("NEAR", near="n" if counted else near[1].lower(), distance=int(near[1]) if counted else 0))
        elif kind == "paren" or text == "-" or text == "NOT" or text.upper() in ("AND", "OR"):
            tokens.append(Token("NEG" if text == "-" else text.upper()))
        else:
            tokens.append(Token("TERM", _proximity_term(text.strip('"') if kind == "quoted" else text, kind == "quoted")))
    return tokens


def _proximity_join(op: Token, left: Node, right: Node) -> Node:
    """NOT beside an AND or a proximity operator becomes one operator with what must not stand there on the right."""
    if op.kind == "NOT":
        op, right = Token("AND"), Node("NOT", (right,))
    negative = [len(n.args) == 1 for n in (left, right)]
    if all(negative) or op.kind == "OR" and any(negative):
        raise Syntax("each alternative needs something to find")
    if negative[0]:
        left, right = right, left
    if any(negative):
        (absent,) = right.args
        if len(absent.args) == 1:
            raise Syntax("NOT stands twice")
        return Node("NOT", (left, absent)) if op.kind == "AND" else Node("NEAR", (left, absent), kind=op.near, distance=op.distance, negated=True)
    return Node(op.kind, (left, right), kind=op.near, distance=op.distance)


def parse_proximity(query: str, most_characters: int = 1024, most_tokens: int = 64) -> Node:
    if len(query) > most_characters:
        raise Syntax("the query is too long")
    tokens = _proximity_tokens(query)
    if len(tokens) > most_tokens:
        raise Syntax("the query has too many words")
    tree = Parser(tokens, {"AND": 0, "NOT": 1, "p": 2, "s": 3, "n": 4, "OR": 5}, _proximity_join).tree()
    if len(tree.args) == 1 or not positive(tree):
        raise Syntax("nothing is asked for")
    return tree


def terms_of(tree: Node) -> list[Node]:
    return [tree] if tree.op == "TERM" else [t for a in tree.args for t in terms_of(a)]


def _parts(term: Node) -> list[str]:
    return regex.findall(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*", term.text)


def beginnings(words: list[str]) -> str:
    """A pattern of the letters with which every form of these words begins: a fold changes two letters at most."""
    return "|".join(dict.fromkeys(regex.escape(fold(w)[: max(1, len(fold(w)) - 2)]) for w in words)) or "(?!)"


def lines_with(lines: DataFrame, tree: Node, text: str = "line") -> DataFrame:
    """The lines that can hold any word of the query, also one that must not stand there."""
    words = [p[:-1] if t.kind == "prefix" and len(p) > 1 else p for t in terms_of(tree) for p in _parts(t)]
    return lines.where(unaccent(F.lower(F.col(text))).rlike(beginnings(words)))


def hits(tree: Node, tokens: DataFrame) -> DataFrame:
    """The tokens that any term of the query names, written: every operator above reads them instead of the texts."""
    terms = terms_of(tree)
    folded = {fold(p) for t in terms if t.kind in ("word", "phrase") for p in _parts(t)}
    asked = tokens.sparkSession.createDataFrame([(f, True) for f in sorted(folded)] or [("", False)], "__key string, __met boolean")
    rows = tokens.join(F.broadcast(asked), F.col("term") == F.col("__key"), "left")  # outer: a filter would be pushed below the fold
    literal = F.lit(False)
    for t in terms:
        if t.kind == "prefix":
            literal = literal | F.startswith(F.lower("word"), F.lit(t.text))
        elif t.kind == "exact":
            literal = literal | F.lower("word").isin(_parts(t))
    return written(rows.where(F.coalesce("__met", F.lit(False)) | literal).drop("__key", "__met"))


def search(tree: Node, tokens: DataFrame, most: int = 1000) -> DataFrame:
    """Spans of a parsed query, over the few tokens that it names."""
    return spans(tree, hits(tree, tokens), most)


def positive(tree: Node) -> bool:
    """Whether the tree has something to list: not only what must not stand there."""
    if tree.op == "TERM":
        return bool(regex.search(r"[\p{L}\p{N}]", tree.text))
    if tree.op == "OR":
        return all(map(positive, tree.args))
    return positive(tree.args[0])


def spans(tree: Node, tokens: DataFrame, most: int = 1000) -> DataFrame:
    """Spans (doc, para, first, last, hits) of the tree over tokens (doc, para, sent, pos, word, term).

    Every join has (doc, para) as its key. AND and NOT look at whole documents; NEAR pairs spans of one paragraph,
    at most `most` for each, by words (the gap is at most n, overlap counts), by sentence or by paragraph; NEAR NOT
    keeps the spans without a partner. Joined spans reach from the first to the last word of both.
    """
    if tree.op == "TERM":
        return _term_spans(tree, tokens)
    left, right = (spans(a, tokens, most) for a in tree.args)
    if tree.op == "OR":
        return left.unionByName(right)
    if tree.op == "NOT":
        return left.join(right.select("doc").distinct(), "doc", "left_anti")
    if tree.op == "AND":
        both = left.select("doc").intersect(right.select("doc"))
        return left.unionByName(right).join(both, "doc", "left_semi")
    a = left.select("doc", "para", *[F.col(c).alias(f"a_{c}") for c in ("first", "last", "sent", "till", "hits")])
    b = right.select(F.col("doc").alias("b_doc"), F.col("para").alias("b_para"), *[F.col(c).alias(f"b_{c}") for c in ("first", "last", "sent", "till", "hits")])
    on = (F.col("doc") == F.col("b_doc")) & (F.col("para") == F.col("b_para"))
    if tree.kind == "n":
        on = on & (F.greatest(F.col("b_first") - F.col("a_last"), F.col("a_first") - F.col("b_last")) <= tree.distance)
    elif tree.kind == "s":
        on = on & (F.col("a_sent") <= F.col("b_till")) & (F.col("b_sent") <= F.col("a_till"))
    if tree.negated:
        return left.join(b, (left.doc == F.col("b_doc")) & (left.para == F.col("b_para")) & _plain(tree, left), "left_anti")
    met = a.join(b, on)
    out = met.select("doc", "para", F.least("a_first", "b_first").alias("first"), F.greatest("a_last", "b_last").alias("last"), F.least("a_sent", "b_sent").alias("sent"), F.greatest("a_till", "b_till").alias("till"), F.concat("a_hits", "b_hits").alias("hits"))
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("doc", "para").orderBy("first", "last", "hits"))
    return out.withColumn("__n", n).where(F.col("__n") <= most).drop("__n")


def _plain(tree: Node, left: DataFrame) -> Column:
    if tree.kind == "n":
        return F.greatest(F.col("b_first") - left["last"], left["first"] - F.col("b_last")) <= tree.distance
    if tree.kind == "s":
        return (left.sent <= F.col("b_till")) & (F.col("b_sent") <= left.till)
    return F.lit(True)


def _term_spans(tree: Node, tokens: DataFrame) -> DataFrame:
    columns = ("doc", "para", "first", "last", "sent", "till", "hits")
    if tree.kind == "prefix":
        hit = tokens.where(F.lower("word").startswith(tree.text))
    else:
        parts = regex.findall(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*", tree.text)
        exact = tree.kind == "exact"
        key = F.lower("word") if exact else F.col("term")
        parts = parts if exact else [fold(p) for p in parts]
        if len(parts) > 1:
            rows = _with_keys(tokens.select("doc", "para", "sent", "pos", key.alias("key")), parts)
            placed = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(parts)]))
            rows = rows.withColumn("part", placed).where("key = part.p").withColumn("first", F.expr("pos - part.i"))
            out = rows.groupBy("doc", "para", "first").agg(F.count(F.lit(1)).alias("n"), F.min("sent").alias("sent"), F.max("sent").alias("till"))
            out = out.where(F.col("n") == len(parts)).withColumn("last", F.col("first") + len(parts) - 1)
            return out.withColumn("hits", F.array(F.struct("first", "last"))).select(*columns)
        hit = _with_keys(tokens.withColumn("key", key), parts[:1])
    out = hit.select("doc", "para", F.col("pos").alias("first"), F.col("pos").alias("last"), "sent", F.col("sent").alias("till"))
    return out.withColumn("hits", F.array(F.struct("first", "last"))).select(*columns)


def _with_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A join with a query's few words: a filter would be pushed below the fold and repeat all of it."""
    asked = rows.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(keys)], "key string")
    return rows.join(F.broadcast(asked), "key").select(rows.columns)
