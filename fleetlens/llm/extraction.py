"""Main text of web pages: a recurrent labeller of blocks.

A page is a sequence of leaf blocks.  Each block is a vector of hashed tag-path features
(tags, classes, ids and roles above it), hashed words, and a few shape numbers; a
bidirectional LSTM in numpy reads the whole sequence in both directions, so each
block is judged in the context of the whole page, and a logistic layer says whether it is
main text.

No table says which blocks are main text.  The labeller learns from pages whose markup
is telling: in a bounded sample, blocks below menus, headers, footers, sidebars, forms,
notices, adverts and comments (by tag or by class word) are labelled as such, and copies
of the sampled pages with more such containers at random places are added, so that
containers are learned that the sample happens to lack.

Pages are read whole and every block is labelled.  Defined cases: a null or empty html,
or a page without main text, gives an empty text; broken markup is read as browsers
would, tags left open end with their parent; repeated pages agree; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.htmlblocks import blocks
from fleetlens.llm.labelled import below_share
from fleetlens.llm.registry import query, table
from fleetlens.llm.textbytes import WordHasher, column_bytes

# executors need not have this package: the task functions travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PATH_DIM = 96
WORD_DIM = 24
SHAPE_DIM = 6
HIDDEN = 16
TRAIN_PAGES = 240  # bound of the training sample
MAX_TRAIN_BYTES = 65536  # longer pages are not trained on; all are read
MAX_TRAIN_BLOCKS = 120  # longer sampled sequences are trained on in stretches
PAGES = 256  # pages labelled together

# fixed values: words of classes, ids and roles that mark what is not the article
MARKED = re.compile(
    r"\.(nav|navbar|navigation|menu|breadcrumbs?|header|masthead|banner|footer|contentinfo|copyright|legal|sidebar|side|aside|complementary|"
    r"widget|ads?|advert|adverts|advertisement|sponsor|sponsored|promo|cookies?|consent|notice|alert|dialog|modal|popup|overlay|comments?|disqus|"
    r"replies|reply|respond|discussion|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|form|pagination|pager|toolbar|hidden|skip)\Z"
)
MARKED_TAGS = frozenset({"nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "head"})

# containers that training pages get at random places, outermost tag first
OTHERS = (
    "nav>ul>li", "header", "header>div", "header>nav>ul>li", "footer", "footer>p", "footer>ul>li", "aside", "aside>p", "aside>ul>li",
    "form", "form>div", "form>p", "div.ad", "div.ads>p", "div.advert", "div.banner>p", "div.sidebar>p", "div.sidebar>ul>li", "div.menu>ul>li", "ul.menu>li",
    "div.navbar>div", "div.breadcrumb>span", "div.cookie>p", "div.cookies", "div.consent>div", "div.notice>p", "div.alert", "div.popup>p", "div.modal>div",
    "section.comments>div", "section.comments>p", "div.comments>div>p", "div.comment>p", "ol.comments>li>p", "li.comment>p", "div.respond>p", "div.share>ul>li",
    "div.social", "div.related>ul>li", "div.related>h3", "div.newsletter>p", "div.subscribe", "div.login>p", "div.search", "div.widget>p", "div.footer>p",
    "div.header>p", "p.copyright", "div.promo>p", "div.sponsored>p", "div.pagination>a", "div.hidden", "dialog>p", "menu>li",
)
ARTICLES = (
    "article>p", "main>p", "article>div>p", "main>article>p", "main>article>section>p", "div.content>p", "div.article>p", "div.post>p", "div.entry>p", "div.main>p",
    "article>ul>li", "article>ol>li", "article>blockquote>p", "article>h2", "article>h1", "article>h3", "main>h1", "main>h2", "article>pre", "article>table>tr>td",
    "article>figure>figcaption", "section>p", "div>p", "p", "article>header>h1", "div.content>h2", "div.content>ul>li",
)


def marked(path: tuple[tuple[str, ...], ...]) -> bool:
    """Whether the markup itself says that a block is not the article."""
    tags = [f[0] for f in path]
    if "header" in tags and not ("article" in tags and tags.index("article") < tags.index("header") and {"h1", "h2"} & set(tags)):
        return True
    return bool(MARKED_TAGS & set(tags)) or any(MARKED.match(w) for f in path for w in f[1:] if w[0] == ".")


def path_vector(path: tuple[tuple[str, ...], ...]) -> np.ndarray:
    """Signed hashed features of the path; inline tags say little and are left out by the parser's blocks."""
    out = np.zeros(PATH_DIM, np.float32)
    words = {w for f in path for w in f} | {f"leaf {path[-1][0]}" if path else "leaf"}
    for word in words:
        h = zlib.crc32(word.encode())
        out[h % PATH_DIM] += 1.0 if h >> 16 & 1 else -1.0
        out[(h >> 8) % PATH_DIM] += 1.0 if h >> 17 & 1 else -1.0
    return out


def vectors(found: list[tuple[str, tuple, int]], hasher: WordHasher, cache: dict) -> np.ndarray:
    """One row per block: path, words, shape."""
    out = np.zeros((len(found), PATH_DIM + WORD_DIM + SHAPE_DIM), np.float32)
    if not found:
        return out
    for i, (_, path, _) in enumerate(found):
        if path not in cache:
            cache[path] = path_vector(path)
        out[i, :PATH_DIM] = cache[path]
    data, offsets = column_bytes(pa.array([t for t, _, _ in found], pa.large_string()))
    h, _, _, bounds = hasher.words(data, offsets)
    n = np.diff(bounds)
    rows = np.repeat(np.arange(len(found)), n)
    sign = np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
    flat = np.bincount(rows * WORD_DIM + (h % np.uint64(WORD_DIM)).astype(np.int64), sign, len(found) * WORD_DIM)
    out[:, PATH_DIM : PATH_DIM + WORD_DIM] = flat.reshape(-1, WORD_DIM) / np.sqrt(np.maximum(n, 1))[:, None]
    size = np.maximum(np.diff(offsets), 1)
    stops = np.concatenate([[0], np.cumsum(np.isin(data, (33, 44, 46, 58, 59, 63)))])
    capitals = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    out[:, -6] = np.log1p(n) / 4
    out[:, -5] = np.array([k for _, _, k in found]) / size
    out[:, -4] = 10 * (stops[offsets[1:]] - stops[offsets[:-1]]) / size
    out[:, -3] = 5 * (capitals[offsets[1:]] - capitals[offsets[:-1]]) / size
    out[:, -2] = np.arange(len(found)) / len(found)
    out[:, -1] = 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output, in numpy."""

    def __init__(self, seed: int = 1):
        rng, d = np.random.default_rng(seed), PATH_DIM + WORD_DIM + SHAPE_DIM
        self.p = {}
        for side in "fb":
            self.p["x" + side] = rng.normal(0, 0.15, (d, 4 * HIDDEN)).astype(np.float32)
            self.p["h" + side] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.p["c" + side] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
        self.p["o"] = rng.normal(0, 0.15, 2 * HIDDEN).astype(np.float32)
        self.p["z"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction over x[t, page]; masked steps leave the state as it is."""
        steps, pages, _ = x.shape
        h = c = np.zeros((pages, HIDDEN), np.float32)
        states, trace = np.zeros((steps, pages, HIDDEN), np.float32), []
        inputs = x @ self.p["x" + side] + self.p["c" + side]
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            a = inputs[t] + h @ self.p["h" + side]
            i, f, o = (_sigmoid(a[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            if keep:
                trace.append((t, i, f, o, g, c, tc, h, m))
            c, h = np.where(m, c2, c), np.where(m, o * tc, h)
            states[t] = h
        return states, trace

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, "f", False)[0], self._run(x, mask, "b", False)[0]], 2)
        return _sigmoid(both @ self.p["o"] + self.p["z"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {side: self._run(x, mask, side, True) for side in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        error = (_sigmoid(both @ self.p["o"] + self.p["z"]) - y) * mask / max(mask.sum(), 1)
        grads = {"o": np.tensordot(error, both, 2), "z": np.array([error.sum()])}
        for k, side in enumerate("fb"):
            from_out = error[:, :, None] * self.p["o"][k * HIDDEN : (k + 1) * HIDDEN]
            dx, dh_w = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(self.p["h" + side])
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, i, f, o, g, c, tc, h, m in reversed(runs[side][1]):
                dh = dh + from_out[t]
                full = dc + dh * o * (1 - tc**2)
                da = np.concatenate([full * g * i * (1 - i), full * c * f * (1 - f), dh * tc * o * (1 - o), full * i * (1 - g**2)], 1) * m
                dx[t] = da
                dh_w += h.T @ da
                dh = np.where(m, da @ self.p["h" + side].T, dh)
                dc = np.where(m, full * f, dc)
            grads["x" + side], grads["h" + side], grads["c" + side] = np.tensordot(x, dx, ((0, 1), (0, 1))), dh_w, dx.sum((0, 1))
        return grads

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], *, rounds: int = 14, rate: float = 0.01, seed: int = 2) -> Labeller:
        """Adam over batches of pages (vectors, labels)."""
        rng, first, second, step = np.random.default_rng(seed), {}, {}, 0
        for turn in range(rounds):
            order = rng.permutation(len(pages))
            order = order[np.argsort([len(pages[i][1]) // 16 for i in order], kind="stable")]
            groups = [order[a : a + 24] for a in range(0, len(order), 24)]
            for g in rng.permutation(len(groups)):
                x, mask = padded([pages[i][0] for i in groups[g]])
                y = np.zeros(mask.shape, np.float32)
                for k, i in enumerate(groups[g]):
                    y[: len(pages[i][1]), k] = pages[i][1]
                step += 1
                for name, grad in self.gradients(x, mask, y).items():
                    grad = np.clip(grad, -1, 1)
                    first[name] = 0.9 * first.get(name, 0) + 0.1 * grad
                    second[name] = 0.99 * second.get(name, 0) + 0.01 * grad**2
                    change = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
                    self.p[name] = (self.p[name] - rate * (1 - turn / rounds) * change).astype(np.float32)
        return self


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as x[t, page] and which of them are there."""
    steps = max((len(p) for p in pages), default=0)
    x = np.zeros((steps, len(pages), PATH_DIM + WORD_DIM + SHAPE_DIM), np.float32)
    mask = np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
        mask[: len(p), k] = True
    return x, mask


def _path(text: str) -> tuple[tuple[str, ...], ...]:
    out: list[tuple[str, ...]] = [("html",), ("body",)]
    for part in text.split(">"):
        tag, _, word = part.partition(".")
        out.append((tag, f"{tag}.{word}", f".{word}") if word else (tag,))
    return tuple(out)


def training_pages(pages: list[str], seed: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """Labelled sequences: each sampled page, and copies with other containers."""
    rng, hasher, cache, out = np.random.default_rng(seed), WordHasher(lower=True), {}, []
    parsed = [p for p in map(blocks, pages) if p]
    texts = [t for p in parsed for t, _, _ in p] or ["Some words, as in any text."]

    def sample(short: bool) -> str:
        words = texts[rng.integers(len(texts))].split()
        n = int(rng.integers(1, 9)) if short and rng.random() < 0.7 else int(rng.integers(3, 120))
        a = int(rng.integers(max(1, len(words) - n)))
        return " ".join(words[a : a + n])

    for page in parsed:
        versions = [[(t, p, k, not marked(p)) for t, p, k in page]]
        for copy in range(2):
            base = list(versions[0])
            if copy:  # the article under other containers, too
                swap = {}
                base = [
                    (t, swap.setdefault(p, _path(ARTICLES[rng.integers(len(ARTICLES))])) if good and rng.random() < 0.9 else p, k, good)
                    for t, p, k, good in base
                ]
            for _ in range(int(rng.integers(1, 5))):
                path = _path(OTHERS[rng.integers(len(OTHERS))])
                inside = base and rng.random() < 0.3
                at = int(rng.integers(len(base) + 1)) if inside else (0 if rng.random() < 0.5 else len(base))
                if inside and at < len(base):  # within the article's own containers
                    path = tuple(f for f in base[at][1][:-1] if f[0] in ("html", "body", "main", "article", "section", "div")) + path[2:]
                group = []
                for _ in range(int(rng.integers(1, 7))):
                    text = sample(True)
                    group.append((text, path, len(text) if rng.random() < 0.4 else 0, False))
                base[at:at] = group
            versions.append(base)
        for version in versions:
            for a in range(0, len(version), MAX_TRAIN_BLOCKS):
                rows = version[a : a + MAX_TRAIN_BLOCKS]
                out.append((vectors([r[:3] for r in rows], hasher, cache), np.array([r[3] for r in rows], np.float32)))
    return out


def extractor(labeller: Labeller, keep: list[str]):
    """Task function: the columns ``keep`` and html in; those, text and counts out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, cache = WordHasher(lower=True), {}
        for big in batches:
            for a in range(0, big.num_rows, PAGES):
                batch = big.slice(a, PAGES)
                found = [blocks(h or "") for h in batch.column("html").to_pylist()]
                texts, counts = [""] * len(found), np.array([len(f) for f in found])
                order = np.argsort(counts, kind="stable")
                order, at = order[counts[order] > 0], 0
                while at < len(order):
                    # pages of like length together, and no more padded steps than a few long pages have
                    end = at + 1
                    while end < len(order) and end - at < 64 and counts[order[end]] <= 1.5 * counts[order[at]] + 4:
                        end += 1
                    group = order[at:end]
                    x, mask = padded([vectors(found[i], hasher, cache) for i in group])
                    score = labeller.scores(x, mask)
                    for k, i in enumerate(group):
                        texts[i] = "\n\n".join(t for (t, _, _), s in zip(found[i], score[: counts[i], k], strict=True) if s >= 0.5)
                    at = end
                if len(cache) > 20_000:
                    cache.clear()
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in keep], pa.array(texts, pa.string()), pa.array(counts)],
                    names=[*keep, "text", "n_blocks"],
                )

    return rows


def main_text(pages: DataFrame) -> DataFrame:
    """Main text of every page.

    Reads ``page_id``, ``url`` and ``html``.  Returns page_id, url, text, n_chars (code points) and
    n_blocks (of the page).
    """
    h = F.xxhash64("page_id", "html")
    short = pages.select("page_id", "html").where(F.octet_length("html") <= MAX_TRAIN_BYTES)
    # a bounded sample in the order of a hash, collected to fit the labeller
    few = short.where(below_share(h, TRAIN_PAGES, pages.count()))
    sample = few.orderBy(h, "page_id").limit(TRAIN_PAGES).collect()
    labeller = Labeller().train(training_pages([r.html for r in sample]))
    rows = pages.select("page_id", "url", "html").mapInArrow(
        extractor(labeller, ["page_id", "url"]), "page_id bigint, url string, text string, n_blocks bigint"
    )
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks")


@query("op4_main_text")
def op4_main_text(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
