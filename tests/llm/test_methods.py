"""Parts of the operators against brute force."""

import collections
import itertools
import math
import random

import numpy as np
import pytest

from folioscope.llm import (decontaminate, jaccard_join, mixing, pu_quality, resharding, site_style, string_kernel,
                            token_counts, voronoi_knn)


def near_copies(seed, n, words, edits):
    """Copies of one text, each with a few words changed."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"v{rng.randrange(40)}"
        out.append(" ".join(copy[:rng.randrange(words - 3, words + 1)]))
    return out


def shingles(text):
    w = text.lower().split()
    return frozenset(tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def test_join_equals_all_pairs(docs):
    texts = near_copies(1, 70, 120, 7) + near_copies(2, 40, 45, 3) + near_copies(3, 40, 12, 1) + near_copies(4, 20, 16, 1)
    texts += [" ".join(texts[i].split()[:60] + texts[100 + i].split()) for i in range(10)] + texts[:5]
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * len(sets[a] | sets[b]):
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
    found = {r.doc_id: (r.component_id, r.n_shingles) for r in jaccard_join.join(docs(list(enumerate(texts)))).collect()}
    assert found == {i: (root[i], len(sets[i])) for i in range(len(texts))}


def test_lists_of_many_components_equal_all_pairs(docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng, texts = random.Random(4), []
    for group in range(2):  # copies of one text, some of which link and some of which just do not
        base = [f"g{group}w{k}" for k in range(90)]
        for k in range(45):
            words = list(base)
            for at in rng.sample(range(90), rng.choice((1, 2, 3, 4))):
                words[at] = f"x{group}y{k}z{at}"
            texts.append(" ".join(words))
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
    assert 4 < len(set(root)) < 90
    for spare in (0, 8):  # all blocks give forests first, or whole pairs at once
        found = jaccard_join.join(docs(list(enumerate(texts))), spare=spare).collect()
        assert {r.doc_id: r.component_id for r in found} == dict(enumerate(root))


def test_a_list_without_links_builds_no_set(docs, monkeypatch):
    """Twelve texts share their first half: lists hold them all, and sketches rule every pair out."""
    texts = [" ".join([f"s{k}" for k in range(60)] + [f"d{i}w{k}" for k in range(40)]) for i in range(12)]
    built, lists, sets, opened = [], [], jaccard_join._sets, jaccard_join._open_lists

    def counted(part, wanted, words):
        built.append(wanted.count())
        return sets(part, wanted, words)

    def watched(entries, roots, light):
        lists.append(entries.filter("size > 4").count())
        return opened(entries, roots, light)

    monkeypatch.setattr(jaccard_join, "_sets", counted)
    monkeypatch.setattr(jaccard_join, "_open_lists", watched)
    assert all(r.component_id == r.doc_id for r in jaccard_join.join(docs(list(enumerate(texts)))).collect())
    assert sum(built) == 0 and lists[0] >= 12


def test_a_list_of_one_block_gives_all_pairs_across_components(spark):
    """Rows 0 to 8 are the list's largest component, 9 and 10 another; every pair passes at one percent."""
    root = [0] * 9 + [9, 9, 11]
    opened = spark.createDataFrame([(1, k, 97, 12, root[k], k < 9, 9) for k in range(12)],
                                   "token long, key long, n long, size long, root long, main boolean, mains long")
    sketches = spark.createDataFrame([(k, 97, bytearray([k] * 8)) for k in range(12)], "key long, n long, sketch binary")
    found = [(r.a, r.b) for r in jaccard_join._block_pairs(opened, sketches, 1, None).collect()]
    assert sorted(found) == [(a, b) for a, b in itertools.combinations(range(12), 2) if root[a] != root[b]]


def test_entries_meet_packed_and_none_is_lost(spark):
    rng = np.random.default_rng(5)
    keys = [7, 9, 7 + (1 << 32), -3, 11]  # the first and the third agree in 32 bits
    entries = [rng.integers(0, 1 << 63, 40, dtype=np.uint64) for _ in keys]
    entries[1][:10], entries[2][20:30], entries[3][:5] = entries[0][:10], entries[0][20:30], entries[1][:5]
    groups, packed = jaccard_join.group_entries(entries, keys)
    assert sum(map(len, packed)) == 8 * 200 and groups == sorted(set(groups))  # 8 bytes an entry, whatever its key
    # pieces of two tasks, one of them with a copy of a class
    more, again = jaccard_join.group_entries(entries[4:], keys[4:])
    blocks = spark.createDataFrame([(g, bytearray(p)) for g, p in zip(groups + more, packed + again, strict=True)],
                                   "group int, packed binary")
    features = spark.createDataFrame([(k, 40) for k in [*keys, 11]], "key long, n long")
    found = collections.defaultdict(set)
    for r in jaccard_join._shared_entries(features, blocks.repartition(3)).collect():
        assert r.key not in found[r.token] and r.n == 40
        found[r.token].add(r.key)
    place = 1 << 64 - 32 - jaccard_join.GROUP_BITS
    wanted = collections.defaultdict(set)
    for key, own in zip(keys, entries, strict=True):
        for e in own.tolist():
            wanted[e // place].add(key)
    hidden = {keys[0], keys[2]}  # they meet in a list of their own, and enter each other's lists
    lists = {t: k | hidden if k & hidden else k for t, k in wanted.items() if len({x & 0xFFFFFFFF for x in k}) > 1}
    assert found == {**lists, -1 - 7: hidden} and len(lists) == 10


def test_sketches_rule_out_no_link():
    rng = np.random.default_rng(3)
    for n in (1, 5, 31, 33, 64, 65, 300, 3000):
        whole = rng.integers(1 << 63, size=2 * n, dtype=np.uint64)
        for drop in range(0, max(1, n // 6), max(1, n // 20)):
            for more in (0, drop):
                a, b = np.unique(whole[:n]), np.unique(whole[drop:n + more])
                both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
                x, _ = jaccard_join.may_link([jaccard_join.sketch(a)], np.array([len(a)]),
                                             [jaccard_join.sketch(b)], np.array([len(b)]), 85)
                assert len(x) or 100 * both < 85 * either


def test_parts_leave_no_linked_sizes_apart():
    for a in range(1, 400):
        for b in range(a, 100 * a // 85 + 1):
            common = set(jaccard_join.ranges_of(a)) & set(jaccard_join.ranges_of(b))
            both_small = b <= jaccard_join.largest_small()
            assert both_small or any(jaccard_join.size_range(c)[0] >= b for c in common)
            for c in common:
                assert a + b - 2 * -(-85 * (a + b) // 185) <= jaccard_join.size_range(c)[1]


def test_components_of_a_path_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    roots = {r.key: r.root for r in jaccard_join.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert roots == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_transfers_move_the_fewest_bytes():
    rng = random.Random(5)
    for _ in range(30):
        old, new = rng.randint(1, 3), rng.randint(1, 4)
        sizes = [[rng.choice((1, 2, 4, 8)) for _ in range(rng.randint(0, 5))] for _ in range(old)]
        blocks = [(s, b, c, c << b) for s, own in enumerate(sizes) for b, c in
                  sorted(collections.Counter(x.bit_length() - 1 for x in own).items())]
        moves = resharding.transfers(blocks, new)
        total = sum(map(len, sizes))
        held = [len(sizes[s]) if s < old else 0 for s in range(new)]
        moved = sum((after - first) << band for _, band, first, after, _ in moves)
        for shard, _, first, after, to in moves:
            held[to] += after - first
            if shard < new:
                held[shard] -= after - first
        assert sum(held) == total and max(held) - min(held) <= 1
        best = math.inf
        for extra in itertools.combinations(range(new), total % new):
            room = [total // new + (s in extra) for s in range(new)]
            best = min(best, sum(sum(sorted(own)[:max(0, len(own) - (room[s] if s < new else 0))])
                                 for s, own in enumerate(sizes)))
        assert moved == best


def test_myers_equals_the_table():
    def table(p, t):
        row = [0] * (len(t) + 1)
        for i in range(1, len(p) + 1):
            now = [i]
            for j in range(1, len(t) + 1):
                now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (p[i - 1] != t[j - 1])))
            row = now
        return min(row), row.index(min(row))

    rng = random.Random(3)
    for _ in range(500):
        p = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 9)))
        t = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 20)))
        assert decontaminate.best_match(p, decontaminate.masks(p), t) == table(p, t)


def test_items_with_errors_up_to_the_budget_are_found():
    rng = random.Random(7)
    letters = "abcdefghijklmnop "
    for _ in range(40):
        item = "".join(rng.choice(letters) for _ in range(rng.randint(40, 200)))
        errors, changed = decontaminate.budget(len(item)), list(item)
        for _ in range(errors):
            at = rng.randrange(len(changed))
            changed[at:at + 1] = rng.choice(([], ["z"], [changed[at], "y"]))
        text = "".join(rng.choice(letters) for _ in range(300)) + "".join(changed) + "".join(
            rng.choice(letters) for _ in range(300))
        found = decontaminate.Matcher([(1, item)]).find(text)
        assert found and found[0][0] <= errors


def test_self_kernel_and_gaps():
    def kernel(a, b):
        def weights(s):
            out = collections.Counter()
            for places in itertools.combinations(range(len(s)), string_kernel.ORDER):
                if all(s[i] for i in places):
                    out[tuple(s[i] for i in places)] += string_kernel.DECAY ** (places[-1] - places[0] + 1)
            return out
        x, y = weights(a), weights(b)
        return sum(x[k] * y[k] for k in x)

    rng = np.random.default_rng(2)
    for n in range(3, 9):
        codes = rng.integers(0, 5, (20, n))
        assert np.allclose(string_kernel.self_kernel(codes), [kernel(c.tolist(), c.tolist()) for c in codes], rtol=1e-5)
    one = string_kernel.table_of("moron")[:, None]
    near, far = string_kernel.values(["moron", "m.o.r.o.n", "mxoron", "table"], one)[:, 0][[0, 1, 2]], \
        string_kernel.values(["table"], one)[0, 0]
    assert abs(near[0] - 1) < 1e-6 and min(near[1:]) > 0.5 and far < 0.1
    row, units = string_kernel.units_of(["you i d i o t , yes", "a b", "c d", None])
    assert [u for u in units if len(u) > 3] == ["idiot,"] and len(row) == len(units)


def test_scoring_reads_few_table_rows_at_a_time_and_changes_no_value():
    rng = np.random.default_rng(3)
    table = rng.normal(size=string_kernel.LETTERS ** string_kernel.ORDER).astype(np.float32)
    table[0] = 0
    units = ["moron", "m.o.r.o.n", "a", "ab", "abc", "?!", "", "it's", "x-y-z", "aaaa", "unbelievablylong.word", "été你好"]
    wanted = string_kernel.values(units, table[:, None])[:, 0]
    assert np.allclose(string_kernel.decisions(units, table), wanted, rtol=1e-9, atol=1e-12)
    assert np.allclose(string_kernel.decisions(units, table, step=2), wanted, rtol=1e-9, atol=1e-12)

    class Counted(np.ndarray):
        calls = 0

        def take(self, *args, **options):
            Counted.calls += 1
            return np.asarray(self).take(*args, **options)

    string_kernel.decisions(["abcdefghijkl"], table.view(Counted))
    assert 0 < Counted.calls <= 11 + 55 + 165  # one per choice of all places but the last, not 66 + 220 + 495

    texts = [["id", "iot", "a"], ["wo", "rth", "less", "you"], [], ["longer-than-five", "id"], ["iot"]]
    row, found = string_kernel.joined(texts)
    assert sorted(zip(row.tolist(), found, strict=True)) == [
        (0, "idiot"), (0, "idiota"), (0, "iota"), (1, "lessyou"), (1, "rthless"), (1, "rthlessyou"), (1, "worth"),
        (1, "worthless"), (1, "worthlessyou")]
    at, read = string_kernel.unmasked(["m0r0n", "plain", "done!", "$1", "l33t!", "b|g"])
    assert (at.tolist(), read) == ([0, 4, 5], ["moron", "leet", "blg"])


def test_machine_learns_insults_and_their_variants():
    rng = random.Random(4)
    syllables = ["th", "er", "on", "an", "re", "in", "the", "at"]
    clean = list({"".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(600)})
    machine = string_kernel.learn({"moron": 50, "idiot": 40, "trash,": 30, "scum": 20}, clean)
    assert min(machine.units(["moron", "m-o-r-o-n", "idiot!", "trash"])) > 0 > max(machine.units(clean[:100]))


def test_positive_unlabelled_fit(spark, docs):
    rng = random.Random(6)
    good = [" ".join(f"word{rng.randrange(500)}" for _ in range(60)) + "." for _ in range(600)]
    bad = [" ".join(["SPAM!!"] * 60) for _ in range(200)]
    rows = docs([(i, t) for i, t in enumerate(good + bad)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(250)], "doc_id long, quality int, toxic int")
    scores = {r.doc_id: r.score for r in pu_quality.score(rows, labels).collect()}
    assert min(scores[i] for i in range(600)) >= 0.7 > max(scores[i] for i in range(600, 800))


def test_segmentation_equals_plain_dynamic_programming():
    rng = random.Random(8)
    scores = {p: -rng.random() * 5 for p in ("▁", "a", "b", "ab", "▁a", "ba", "abb", "▁ab")}
    words = sorted({"".join(rng.choices("abcé", k=rng.randint(1, 8))) for _ in range(200)})
    for word, (count, score) in zip(words, token_counts.segment(words, scores, 3), strict=True):
        text, best = "▁" + word, [(0.0, 0)]
        for end in range(1, len(text) + 1):
            n = len(text[end - 1].encode())
            options = [(best[end - 1][0] + n * token_counts.BYTE_SCORE, -(-best[end - 1][1] + n))]
            options += [(best[s][0] + scores[text[s:end]], -(-best[s][1] + 1)) for s in range(max(0, end - 3), end)
                        if text[s:end] in scores]
            best.append(max(options))
        assert (count, pytest.approx(score)) == (-best[-1][1], best[-1][0])


def test_neighbours_equal_all_pairs(spark):
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.normal(size=(300, 6)), np.tile(rng.normal(size=(1, 6)), (120, 1))]).round(2)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    q = np.floor(256 * v).astype(np.int64)
    expected = set()
    for i in range(0, len(v), 50):
        order = sorted((j for j in range(len(v)) if j != i), key=lambda j: (-int(q[i] @ q[j]), j))[:5]
        expected |= {(i, r, j, int(q[i] @ q[j])) for r, j in enumerate(order, 1)}
    for blocks in (1024, 40):
        found = {tuple(r) for r in voronoi_knn.top_k(df, pivots=5, block_rows=blocks).collect()}
        assert found == expected


def test_bounds_keep_queries_out_of_most_cells_of_clustered_vectors(spark):
    rng = np.random.default_rng(10)
    middles = rng.normal(size=(24, 16))
    v = np.concatenate([m + 0.05 * rng.normal(size=(60, 16)) for m in middles]).round(3)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    q = np.floor(256 * v)
    rows = voronoi_knn.quantised(df)
    centres = voronoi_knn.choose_pivots(rows, 40)
    cells = voronoi_knn.summaries(voronoi_knn.assign_cells(rows, centres), centres)[16]
    assert cells.counts.sum() == len(v)
    scores = q[::50] @ q.T
    least = np.sort(scores, axis=1)[:, -6]  # the fifth besides the query itself, at the worst
    hit = voronoi_knn.reached(q[::50], cells, least)
    assert (hit * cells.counts).sum() / (len(hit) * len(v)) < 0.3
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in voronoi_knn.top_k(df, pivots=40).collect()}
    for i, row in zip(range(0, len(v), 50), scores, strict=True):
        order = sorted((j for j in range(len(v)) if j != i), key=lambda j: (-int(row[j]), j))[:5]
        assert [found[i, r] for r in range(1, 6)] == [(j, int(row[j])) for j in order]


def test_source_targets(docs):
    rows = [(i, "w " * (5 + i), "en", s, 0) for i, s in enumerate(["a"] * 30 + ["b"] * 10 + ["c"] * 10 + [None] * 3)]
    drawn = mixing.decide(docs(rows), ["doc_id", "source"]).collect()
    sizes, weights = collections.Counter(), {"a": 3, "b": 1, "c": 2, None: 3}
    for r in drawn:
        sizes[r.source] += r.size
    left, target = set(weights), {}
    budget = 1.5 * sum(sizes.values())
    while left:  # plain resharing
        share = {s: budget * weights[s] / sum(weights[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in over} if over else share
        budget -= sum(2 * sizes[s] for s in over)
        left = left - over if over else set()
    assert {r.source: pytest.approx(r.target) for r in drawn} == target
    for s in weights:
        taken = sum(r.copies * r.size for r in drawn if r.source == s)
        assert abs(taken - target[s]) <= max(r.size for r in drawn if r.source == s)


def test_shared_branch_goes_and_articles_stay(spark):
    body = "<html><body><div class='x7'>{}</div><div class='story'><p>{}</p></div></body></html>"
    rows = [(i, f"http://host/{i}", body.format("Same words everywhere", f"Text number {i}")) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in site_style.extract(pages).collect()} == {i: f"Text number {i}" for i in range(30)}
    copies = [(i, f"http://other/{i}", "<body><article><p>One article.</p></article></body>") for i in range(30)]
    pages = spark.createDataFrame(copies, "page_id long, url string, html string")
    assert {r.text for r in site_style.extract(pages).collect()} == {"One article."}


def test_markup_is_read_as_browsers_do():
    def text(html):
        return site_style.main_text(html, set())
    assert text("<html><head><title>T</title><body><p>hello</p>") == "hello"
    assert text("<head><title>T</title><p>hello</p>") == "hello"
    assert text('<p style="overflow:hidden">a</p><p title="hidden gems">b</p><p hidden>c</p><p hidden="">d</p>') == "a\n\nb"
    article = '<article><div class="post-header"><h1>T</h1></div><header class="entry-header"><h2>S</h2></header>{}</article>'
    kept = '<p class="share-price">p</p><p class="related-work">w</p><p class="article-notice">n</p>'
    gone = "".join(f'<div class="{c}">x</div>' for c in (
        "share-buttons", "cookie-notice", "site-header", "related posts", "notice", "comment-list", "sidebar left", "ad"))
    assert text(article.format(kept + gone)) == "T\n\nS\n\np\n\nw\n\nn"


def test_bad_labels_are_not_used(spark, docs):
    rng = random.Random(7)
    rows = docs([(i, " ".join(f"word{rng.randrange(300)}" for _ in range(50)) + "." * (i % 3)) for i in range(200)])
    good = [(i, 1, 0) for i in range(60)]
    bad = [(i, 0, 0) for i in range(100, 160)]
    schema = "doc_id long, quality int, toxic int"
    one, two = ({r.doc_id: round(r.score, 9) for r in pu_quality.score(rows, spark.createDataFrame(x, schema)).collect()}
                for x in (good, good + bad))
    assert one == two


def test_masked_split_and_inserted_forms_of_learned_insults():
    rng = random.Random(4)
    syllables = ["th", "er", "on", "an", "re", "in", "the", "at"]
    clean = list({"".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(600)})
    insults = {"moron": 50, "idiot": 40, "trash": 30, "scum": 20, "worthless": 25}
    machine = string_kernel.learn(insults, clean)
    harmless = max(machine.units(clean).max(), machine.texts([" ".join(clean[i:i + 8]) for i in range(0, 600, 8)]).max())
    for word in insults:
        half = len(word) // 2
        looks = word.translate(str.maketrans("ois", "015"))
        forms = [looks, "-".join(word), "x".join(word), *[word[:i] + "*" + word[i + 1:] for i in range(len(word))]]
        split = [f"you {word[:half]} {word[half:]} there", f"{word[:2]} {word[2:4]} {word[4:]}"]
        assert machine.units(forms).min() > harmless + 0.3, word
        assert machine.texts([*split, looks]).min() > 0 and machine.units([f"such{word}ness"])[0] > 0, word
