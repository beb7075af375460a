"""Main text of HTML pages: a recurrent network labels every block with all of the page in view."""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shrinkwise.llm.common import fields, map_batches
from shrinkwise.llm.file_texts import decode
from shrinkwise.llm.page_blocks import Block, Path, PathTree, page_blocks

#: Pages the labeller is trained on at most, and blocks of each at most, from a random place on; the characters of a
#: block that training sees, and of its path: a block with a longer path is not shown. Labelling knows no such bounds.
SAMPLE_PAGES = 400
SAMPLE_BLOCKS = 60
SAMPLE_CHARS = 2_000
#: Sizes of the hashed vectors of tag paths and of words, and of the state in either direction.
PATH_SIZE = 40
WORD_SIZE = 8
STATE = 20
EPOCHS = 30
BATCH = 32
SEED = 11
#: Blocks that go through the network at once; a longer page takes several turns, with the state carried on.
BLOCKS_AT_ONCE = 20_000
#: Words and paths whose vectors a task remembers, and words that it looks up at once.
REMEMBERED = 1 << 17
WORDS_AT_ONCE = 1 << 16

# Names of tags, classes and ids that pages commonly give to what is not their article, and to it.
ASIDE_NAMES = tuple(
    "nav header footer aside form menu .menu .nav .navbar .navigation .header .footer .masthead .sidebar .ad .ads .advert .advertisement .sponsored"
    " .promo .banner .cookie .cookies .consent .notice .alert .popup .modal .comments .comment .reply .disqus .related .recommended .share .social"
    " .newsletter .subscribe .signup .login .search .breadcrumb .breadcrumbs .pagination .pager .copyright .legal .widget .tags .toolbar .skip"
    " .complementary .contentinfo .dialog button label select textarea fieldset option dialog head title".split()
)
ARTICLE_NAMES = tuple("article main .article .content .main .post .entry .story .body .text .page .markdown .prose".split())
# Containers that stand for others in training pages.
ARTICLES = (("article",), ("main",), ("div", ".content"), ("div", ".post", ".body"), ("section", ".entry"), ("div", ".article"), ("article", ".post"), ("div", ".main", ".text"))
ASIDES = {
    "menu": ((("nav",), ("ul",), ("li",), ("a",)), (("div", ".menu"), ("ul",), ("li",), ("a",)), (("header",), ("nav",), ("a",)), (("div", ".breadcrumb"), ("a",)), (("ul", ".navigation"), ("li",), ("a",))),
    "header": ((("header",),), (("header",), ("h1",)), (("div", ".header"), ("p",)), (("div", ".masthead"),), (("header",), ("p",))),
    "footer": ((("footer",),), (("footer",), ("p",)), (("div", ".footer"), ("ul",), ("li",)), (("div", ".copyright"),), (("div", ".legal"), ("p",))),
    "sidebar": ((("aside",),), (("aside",), ("ul",), ("li",)), (("div", ".sidebar"), ("p",)), (("aside", ".related"), ("h2",)), (("div", ".widget"), ("ul",), ("li",), ("a",)), (("div", ".related"), ("a",))),
    "notice": ((("div", ".cookie", ".notice"),), (("div", ".cookie", ".banner"), ("p",)), (("div", ".notice"), ("p",)), (("div", ".alert"),), (("div", ".consent"), ("p",)), (("section", ".newsletter"), ("p",))),
    "advert": ((("div", ".ad"),), (("div", ".advert"), ("p",)), (("aside", ".ad"),), (("div", ".sponsored"), ("a",)), (("div", ".promo"), ("p",)), (("div", ".ads", ".banner"),)),
    "form": ((("form",), ("label",)), (("form",), ("button",)), (("form", ".search"), ("p",)), (("form",), ("fieldset",), ("legend",)), (("form",), ("select",), ("option",)), (("form",),)),
    "comments": ((("section", ".comments"), ("p",)), (("div", ".comments"), ("div", ".comment"), ("p",)), (("ol", ".comment", ".list"), ("li",)), (("div", ".comment"),), (("section", ".comments"), ("h2",)), (("section", ".comments"), ("article", ".comment"), ("p",))),
}
INNER = (("p",), ("h2",), ("blockquote",), ("li",), ("pre",), ("div",), ("td",), ("h1",), ("figcaption",))


@dataclass(frozen=True)
class BlockLabeller:
    """Weights of the two directions and of the output."""

    weights: tuple[np.ndarray, ...]

    def labels(self, pages: list[list[Block]], vectors: Vectors) -> list[np.ndarray]:
        """Whether each block belongs to its page's main text, from the whole page."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            some = [order.pop()]
            while order and (len(some) + 1) * len(pages[some[0]]) <= BLOCKS_AT_ONCE:
                some.append(order.pop())
            for i, logits in zip(some, self._logits([pages[i] for i in some], vectors), strict=True):
                out[i] = logits > 0
        return out

    def _logits(self, pages: list[list[Block]], vectors: Vectors) -> list[np.ndarray]:
        """Output of every block. Only numbers are kept of what either direction reads."""
        wf, uf, bf, wb, ub, bb, v, c = self.weights
        ahead, back = _Direction(wf, uf, bf, v[:STATE]), _Direction(wb, ub, bb, v[STATE:])
        longest = len(pages[0])
        if len(pages) == 1 and longest > BLOCKS_AT_ONCE:
            starts = range(0, longest, BLOCKS_AT_ONCE)
            piece = lambda at: vectors.blocks(pages[0][at : at + BLOCKS_AT_ONCE])[:, None]
            forth = np.concatenate([ahead.read(piece(at)) for at in starts])
            return [(forth + np.concatenate([back.read(piece(at)[::-1])[::-1] for at in reversed(starts)][::-1]))[:, 0] + c]
        rows = vectors.blocks([b for p in pages for b in p])
        x, sizes = _padded(np.split(rows, np.cumsum([len(p) for p in pages])[:-1]))
        both = ahead.read(x) + _reversed(back.read(_reversed(x, sizes)), sizes) + c
        return [both[: len(p), i] for i, p in enumerate(pages)]


class _Direction:
    """An LSTM that reads steps of pages and goes on where it stopped; gives its share of the output for each."""

    def __init__(self, w: np.ndarray, u: np.ndarray, b: np.ndarray, v: np.ndarray):
        # A sigmoid is a tanh of half its argument: with that in the weights, one tanh serves all gates.
        half = np.repeat([0.5, 0.5, 0.5, 1.0], STATE)
        self.w, self.u, self.b, self.v = ((m * half).astype(np.float32) if m is not v else v.astype(np.float32) for m in (w, u, b, v))
        self.h = self.c = None

    def read(self, x: np.ndarray) -> np.ndarray:
        if self.h is None:
            self.h = self.c = np.zeros((x.shape[1], STATE), np.float32)
        out, read, h, c = np.empty(x.shape[:2], np.float32), x @ self.w + self.b, self.h, self.c
        for t in range(len(x)):
            z = np.tanh(read[t] + h @ self.u)
            gates = 0.5 + 0.5 * z[:, : 3 * STATE]
            c = gates[:, STATE : 2 * STATE] * c + gates[:, :STATE] * z[:, 3 * STATE :]
            h = gates[:, 2 * STATE :] * np.tanh(c)
            out[t] = h @ self.v
        self.h, self.c = h, c
        return out


def fit_block_labeller(files: DataFrame, rel_path: str = "rel_path", content: str = "content", sample_pages: int = SAMPLE_PAGES) -> BlockLabeller:
    """Trains the labeller on at most `sample_pages` of the given pages, chosen by a hash of rel_path and content.

    There are no labels to learn from: names of tags, classes and ids around a block say in most pages
    what it is, and those are the labels. Each page is also shown with other names for its
    containers and with further menus, headers, notices, adverts, forms, sidebars and reader comments made of
    its own words, so that the network knows more templates than those pages have.

    Executors cut the chosen pages to excerpts of SAMPLE_BLOCKS blocks with SAMPLE_CHARS characters each; only
    `sample_pages` excerpts come to the driver, whatever the pages' sizes and however often one is repeated. Null paths are left out.
    """
    named = files.where(F.col(rel_path).isNotNull()).select(F.col(content).alias("content"), F.xxhash64(rel_path, content).alias("hash"))
    last = named.select("hash").orderBy("hash").limit(sample_pages).agg(F.max("hash")).first()[0]
    chosen = named.where(F.col("hash") <= F.lit(last).cast("bigint"))

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        hashes = batch.column(1).to_pylist()
        return {"hash": hashes, "blocks": [_excerpt(page_blocks(_html(h)), seed) for h, seed in zip(batch.column(0).to_pylist(), hashes, strict=True)]}

    shown = map_batches(chosen, run, fields(chosen, ["hash"], "blocks array<struct<text:string,path:array<array<string>>,linked:int>>"))
    rows = shown.orderBy("hash", F.to_json("blocks")).limit(sample_pages).collect()
    tree = PathTree()
    pages = [[Block(b.text, tree.path(tuple(t) for t in b.path), b.linked) for b in r.blocks] for r in rows]
    return _train([p for p in pages if p], tree)


def extract_main_text(files: DataFrame, labeller: BlockLabeller, rel_path: str = "rel_path", content: str = "content") -> DataFrame:
    """Main text of every HTML file: (rel_path, text), a row per input row; empty if there is none.

    `content` is text, or the bytes that scan_files reads, which are decoded as decode_files does. A page becomes a sequence of
    blocks: text between tags that start or end a block, character references
    decoded, white space turned into single spaces. Scripts, styles and comments in the markup are no text. A
    bidirectional LSTM in numpy reads each block's hashed tag path, hashed words, size and links, in order and
    against it, and labels the block with the whole page in view. Blocks of the main text are joined by line
    ends; nothing is cut. Memory for a page is in proportion to its size, also if no tag is ever closed.

    Null and empty pages have an empty text. Rows that share a rel_path are read each on its own; rel_path may be
    any column, also a struct. Other columns are ignored. No rows give no rows.
    """

    def run(batch: pa.RecordBatch, vectors: Vectors) -> dict[str, object]:
        pages = [page_blocks(_html(html), vectors.tree) for html in batch.column(1).to_pylist()]
        texts = ["\n".join([b.text for b, main in zip(p, kept.tolist(), strict=True) if main]) for p, kept in zip(pages, labeller.labels(pages, vectors), strict=True)]
        vectors.forget()
        return {rel_path: batch.column(0), "text": texts}

    return map_batches(files.select(rel_path, content), run, fields(files, [rel_path], "text string"), Vectors)


def _html(content: str | bytes | None) -> str | None:
    return decode(content)[0] if isinstance(content, bytes) else content


def _excerpt(blocks: list[Block], seed: int) -> list[tuple[str, list[tuple[str, ...]], int]]:
    """Some neighbouring blocks as plain values of bounded size."""
    first = random.Random(seed).randrange(max(1, len(blocks) - SAMPLE_BLOCKS + 1))
    out = []
    for block in blocks[first : first + SAMPLE_BLOCKS]:
        size, at = 0, block.path
        while at.outer is not None and size <= SAMPLE_CHARS:
            size, at = size + sum(map(len, at.tokens)), at.outer
        if size <= SAMPLE_CHARS:
            out.append((block.text[:SAMPLE_CHARS], block.path.tags(), min(block.linked, SAMPLE_CHARS)))
    return out


def named_label(block: Block) -> bool:
    """What the names around a block say: part of the main text unless one of them is an aside's, or, without
    an article's name, if it is a sentence and not a link. A header in an article is the article's."""
    inside = False
    for tokens in block.path.tags():
        article = any(t in ARTICLE_NAMES for t in tokens)
        if any(t in ASIDE_NAMES for t in tokens) and not (inside and tokens[0] == "header"):
            return False
        inside |= article
    return inside or (len(block.text.split()) >= 10 and 2 * block.linked < len(block.text))


def _varied(blocks: list[Block], labels: list[bool], rng: random.Random, tree: PathTree) -> tuple[list[Block], list[bool]]:
    """The page with another container for its article and further asides of its own words."""
    article = rng.choice(ARTICLES)
    out: list[tuple[Block, bool]] = []
    words = " ".join(b.text for b in blocks).split() or ["text"]

    def rest(kind: str, within: tuple = ()) -> None:
        for path in [rng.choice(ASIDES[kind])] * rng.choice((1, 1, 2, 4)):
            at, n = rng.randrange(len(words)), rng.choice((1, 2, 4, 8, 20, 40))
            text = " ".join(words[at : at + n])
            out.append((Block(text, tree.path((("html",), ("body",), *within, *path)), len(text.replace(" ", "")) if ("a",) in path else 0), False))

    for kind in rng.sample(["menu", "header", "notice", "advert"], rng.randint(0, 3)):
        rest(kind)
    wrap = ((("div",),) if rng.random() < 0.3 else ()) + ((("div", ".wrapper"),) if rng.random() < 0.3 else ())
    for block, main in zip(blocks, labels, strict=True):
        if main:
            inner = rng.choice(INNER) if rng.random() < 0.4 else next((t for t in reversed(block.path.tags()) if t[0] in ("p", "h1", "h2", "li")), ("p",))
            out.append((Block(block.text, tree.path((("html",), ("body",), *wrap, article, inner)), block.linked), True))
            if rng.random() < 0.06:
                rest(rng.choice(("advert", "form", "sidebar", "notice")), (*wrap, article))
        elif rng.random() < 0.7:
            out.append((block, False))
    if rng.random() < 0.3:
        rest("comments", (*wrap, article) if rng.random() < 0.5 else ())
    for kind in rng.sample(["sidebar", "comments", "form", "footer", "advert", "menu"], rng.randint(0, 4)):
        rest(kind)
    return [b for b, _ in out], [y for _, y in out]


def _hashed(tokens: list[str], size: int) -> np.ndarray:
    """A row of signs from each token's hash."""
    bits = np.frombuffer(b"".join([xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"), size) for t in tokens]), np.uint8)
    return np.unpackbits(bits.reshape(-1, 16), axis=1)[:, :size].astype(np.int8) * np.int8(2) - np.int8(1)


class Vectors:
    """Vectors of blocks; those of paths and words are remembered."""

    def __init__(self, tree: PathTree | None = None) -> None:
        self.tree = tree or PathTree()
        self.words: dict[str, int] = {}
        self.signs = np.zeros((REMEMBERED, WORD_SIZE), np.int8)

    def forget(self) -> None:
        """Starts a new tree of paths where this one has grown large; for when no block of it is needed any more."""
        if self.tree.size > REMEMBERED:
            self.tree = PathTree()

    def path(self, path: Path) -> np.ndarray:
        """Sum over the distinct tokens of a path, those of the innermost tag once more by themselves: each path
        adds its own fresh tokens to what is outside of it."""
        if path.vector is None:
            new, at = [], path
            while at.outer is not None and at.vector is None:
                new.append(at)
                at = at.outer
            total = at.vector[0] if at.vector is not None else np.zeros(PATH_SIZE, np.float32)
            for at in reversed(new):
                if at.fresh:
                    total = total + 0.5 * _hashed(list(at.fresh), PATH_SIZE).sum(axis=0, dtype=np.float32)
                at.vector = (total, None)
            own = total
            if path.tokens:
                own = total + 0.25 * _hashed([f"last {t}" for t in path.tokens], PATH_SIZE).sum(axis=0, dtype=np.float32)
            path.vector = (total, own)
        elif path.vector[1] is None:
            total = path.vector[0]
            path.vector = (total, total + 0.25 * _hashed([f"last {t}" for t in path.tokens], PATH_SIZE).sum(axis=0, dtype=np.float32))
        return path.vector[1]

    def word_sums(self, split: list[list[str]]) -> np.ndarray:
        """Sums of the vectors of each block's words, a bounded number of words at a time."""
        sums = np.zeros((len(split), WORD_SIZE), np.float32)
        owners = np.repeat(np.arange(len(split)), [len(s) for s in split])
        words = [w for s in split for w in s]
        for at in range(0, len(words), WORDS_AT_ONCE):
            some, owner = words[at : at + WORDS_AT_ONCE], owners[at : at + WORDS_AT_ONCE]
            if len(self.words) + len(some) > REMEMBERED:
                self.words.clear()
            known = self.words
            if new := [w for w in dict.fromkeys(some) if w not in known]:
                self.signs[len(known) : len(known) + len(new)] = _hashed(new, WORD_SIZE)
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            signs = self.signs[[known[w] for w in some]]
            firsts = np.flatnonzero(np.diff(owner, prepend=-1))
            sums[owner[firsts]] += np.add.reduceat(signs, firsts, axis=0, dtype=np.float32)
        return sums

    def blocks(self, blocks: list[Block]) -> np.ndarray:
        """A row per block: its path, all of its words, and its size, links and signs."""
        rows = np.zeros((len(blocks), PATH_SIZE + WORD_SIZE + 5), np.float32)
        split = [b.text.lower().split(" ") for b in blocks]
        n_words, sizes = np.array([len(s) for s in split]), np.array([len(b.text) for b in blocks])
        rows[:, :PATH_SIZE] = [self.path(b.path) for b in blocks]
        rows[:, PATH_SIZE:-5] = self.word_sums(split) / (4 * n_words[:, None])
        rows[:, -5] = np.log1p(sizes) / 5
        rows[:, -4] = np.minimum(1.0, np.array([b.linked for b in blocks]) / sizes)
        rows[:, -3] = [b.text[-1] in ".!?" for b in blocks]
        rows[:, -2] = n_words < 4
        rows[:, -1] = 1
        return rows


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences as (step, page, feature), and their lengths."""
    sizes = np.array([len(p) for p in pages])
    x = np.zeros((sizes.max(), len(pages), pages[0].shape[1]), pages[0].dtype)
    for i, page in enumerate(pages):
        x[: len(page), i] = page
    return x, sizes


def _reversed(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each sequence back to front; what follows its end stays."""
    steps = np.arange(len(x))[:, None]
    return x[np.where(steps < sizes, sizes - 1 - steps, steps), np.arange(x.shape[1])]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * z)


def _lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """States of an LSTM over the steps, and what its gradient needs."""
    h, c = np.zeros((x.shape[1], STATE)), np.zeros((x.shape[1], STATE))
    read, states, kept = x @ w + b, np.zeros((*x.shape[:2], STATE)), []
    for t in range(len(x)):
        z = read[t] + h @ u
        i, f, o = (_sigmoid(z[:, k * STATE : (k + 1) * STATE]) for k in range(3))
        g = np.tanh(z[:, 3 * STATE :])
        before, c_before = h, c
        c = f * c + i * g
        wide = np.tanh(c)
        h = states[t] = o * wide
        kept.append((before, c_before, i, f, o, g, wide))
    return states, kept


def _lstm_gradient(x: np.ndarray, u: np.ndarray, kept: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dz_all, du = np.zeros((*x.shape[:2], 4 * STATE)), np.zeros_like(u)
    dh, dc = np.zeros(d_states.shape[1:]), np.zeros(d_states.shape[1:])
    for t in range(len(x) - 1, -1, -1):
        before, c_before, i, f, o, g, wide = kept[t]
        dh = dh + d_states[t]
        dc = dc + dh * o * (1 - wide * wide)
        dz = np.hstack([dc * g * i * (1 - i), dc * c_before * f * (1 - f), dh * wide * o * (1 - o), dc * i * (1 - g * g)])
        dz_all[t], du = dz, du + before.T @ dz
        dh, dc = dz @ u.T, dc * f
    return np.einsum("tnd,tnz->dz", x, dz_all), du, dz_all.sum(axis=(0, 1))


def _forward(weights: tuple[np.ndarray, ...], x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, tuple]:
    wf, uf, bf, wb, ub, bb, v, c = weights
    ahead, kept_ahead = _lstm(x, wf, uf, bf)
    mirrored = _reversed(x, sizes)
    back, kept_back = _lstm(mirrored, wb, ub, bb)
    both = np.concatenate([ahead, _reversed(back, sizes)], axis=2)
    return both @ v + c, (both, mirrored, kept_ahead, kept_back)


def _train(pages: list[list[Block]], tree: PathTree) -> BlockLabeller:
    """Adam on the log loss of every block, over the pages as they are and varied anew in every epoch."""
    rng, random_pages = np.random.default_rng(SEED), random.Random(SEED)
    size = PATH_SIZE + WORD_SIZE + 5
    scale = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    bias = np.repeat([0.0, 1.0, 0.0, 0.0], STATE)
    weights = [scale(size, 4 * STATE), scale(STATE, 4 * STATE), bias.copy(), scale(size, 4 * STATE), scale(STATE, 4 * STATE), bias.copy(), scale(2 * STATE), np.zeros(1)]
    labels = [[named_label(b) for b in page] for page in pages]
    first, second = ([np.zeros_like(p) for p in weights] for _ in range(2))
    vectors = Vectors(tree)
    step, steps = 0, EPOCHS * max(1, -(-len(pages) // BATCH))
    for _ in range(EPOCHS):
        shown = [_varied(p, y, random_pages, tree) if random_pages.random() < 0.6 else (p, y) for p, y in zip(pages, labels, strict=True)]
        shown = sorted((s for s in shown if s[0]), key=lambda s: len(s[0]) + random_pages.random() * 8)
        batches = [shown[i : i + BATCH] for i in range(0, len(shown), BATCH)]
        random_pages.shuffle(batches)
        for batch in batches:
            step += 1
            x, sizes = _padded([vectors.blocks(p).astype(float) for p, _ in batch])
            y, valid = np.zeros(x.shape[:2]), np.arange(len(x))[:, None] < sizes
            for i, (_, labelled) in enumerate(batch):
                y[: len(labelled), i] = labelled
            for i, gradient in enumerate(_gradients(weights, x, sizes, y, valid)):
                first[i] = 0.9 * first[i] + 0.1 * gradient
                second[i] = 0.99 * second[i] + 0.01 * gradient * gradient
                rate = 1e-2 * min(1.0, 2 - 2 * step / (steps + 1))
                weights[i] = weights[i] - rate * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return BlockLabeller(tuple(weights))


def _gradients(weights: list[np.ndarray], x: np.ndarray, sizes: np.ndarray, y: np.ndarray, valid: np.ndarray) -> list[np.ndarray]:
    logits, (both, mirrored, ahead, back) = _forward(tuple(weights), x, sizes)
    d = valid * (_sigmoid(logits) - y) / valid.sum()
    d_both = d[:, :, None] * weights[6]
    gradients_ahead = _lstm_gradient(x, weights[1], ahead, d_both[:, :, :STATE])
    gradients_back = _lstm_gradient(mirrored, weights[4], back, _reversed(d_both[:, :, STATE:], sizes))
    return [*gradients_ahead, *gradients_back, np.einsum("tns,tn->s", both, d), np.array([d.sum()])]
