import math
import random
from collections import Counter

import pytest

from deedloom.llm import stuffing

NATURAL = [
    "Has anyone tried to change the delivery window before sending it to the other side? The template still contains the old clause.",
    "Thanks, that's exactly what I needed for the form! Thanks, that's exactly what I needed for the list! Thanks, that's exactly what I needed for the plan!",
    "Packing list:\n1. reference letter, not needed before February\n2. spare key, signed\nI would translate the table first and worry about the appendix later, as the other side will ask for it.",
    "- https://a.example/x : If the letter is missing, they'll usually ask for the other one instead, and that takes weeks.\n- https://b.example/y : Is it normal that the clause refers to a page that doesn't exist in the file?",
    "[code]\n14:26 WARN parser: page 7 skipped\n14:27 WARN parser: page 8 skipped\n14:28 WARN parser: page 9 skipped\n[/code]\nCould you tell me what this means?",
    "[removed]", "", " ", None, "支払期限の返事がありません。\n- http://a.example/1/2/3 : 第22条の支払期限を読み直してください。署名欄を先に確認した方がいいと思います。" * 2,
]
STUFFED = [
    "cheap watch replica online | cheap watch replica sale | cheap watch replica best | cheap watch replica 2024 | cheap watch replica price",
    "Why watch replica? Since watch replica is online watch replica! Compare watch replica with watch replica, then order watch replica. Get watch replica in Mossgate.",
    " ".join(f"https://shop{i}.example/watch-replica-best" for i in range(6)),
    "Tags: mossgate, seo_backlinks2024, nda-template, pallet jack, loanshop, karlsmoor, logo design, tea online, casino code, puerto lindo",
    "oak watch; SKU19212; 237.99 EUR; mini safe; SKU16349; SKU62941; 175.99 EUR; steel jack; bestbinder; topshredder",
    "logo design in Ostheim. logo design near Karlsmoor. logo design in Mossgate. logo design Saltreach. logo design in Pellan Cross.",
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, share string")


def test_found(spark):
    df = frame(spark, NATURAL + STUFFED + STUFFED)
    n = len(NATURAL)
    assert {r.doc_id for r in stuffing.stuffed(df, "doc_id", "text").collect()} == set(range(n, n + 2 * len(STUFFED)))


def brute_force(texts):
    """Every measure of every text, from counts in dictionaries."""
    folded = [stuffing.fold(t or "") for t in texts]
    copies = Counter(t or "" for t in texts)
    one = Counter(w for f in folded for w in f.stream())
    two = sum((stuffing.pairs_of(f) for f in folded), Counter())
    total, shares, strongs = sum(one.values()), [], []
    out = []
    share = lambda f, n: (n + stuffing.LINK_WORDS * f.links) / max(1, len(f.stream()) + stuffing.LINK_WORDS * f.links + f.code)
    for t, f in zip(texts, folded):
        own, inside, c, n = stuffing.pairs_of(f), stuffing.inside_of(f), copies[t or ""], len(f.stream())
        pmi = {p: math.log(two[p] * total / (one[p[0]] * one[p[1]])) for p in own}
        others = {p: max(0, two[p] - c * m) for p, m in own.items()}
        strong = {
            p for p, m in own.items() if inside[p] >= stuffing.REPEATED and pmi[p] >= stuffing.COLLOCATION_PMI and m * max(1, total - c * n) >= stuffing.BURST * n * others[p]
        }
        m = sum(own.values())
        out.append({"mean_pmi": sum(pmi[p] * k for p, k in own.items()) / m if m else None, "repeated": sum(own[p] for p in strong) / m if m else None, "n_words": n})
        strongs.append(strong)
        shares.append(share(f, stuffing.stuffing_words(f, strong)))
    for k, (t, f) in enumerate(zip(texts, folded)):
        c, sums = copies[t or ""], []
        for w, m in Counter(f.stream()).items():
            there = [s for g, s in zip(folded, shares) if w in g.stream()]
            if len(there) > c:
                sums.append((w, m, max(0, sum(there) - c * shares[k]) / (len(there) - c)))
        out[k]["company"] = sum(m * x for _, m, x in sums) / sum(m for _, m, _ in sums) if sums else None
        ordinary = {w for w, _, x in sums if x < stuffing.ORDINARY} if shares[k] >= stuffing.MAJORITY else set()
        n = stuffing.stuffing_words(f, strongs[k], ordinary)
        out[k] |= {"n_stuffing": n + stuffing.LINK_WORDS * f.links, "share": share(f, n)}
    return out


def test_scores_are_the_same_by_brute_force(spark):
    texts = NATURAL + STUFFED + STUFFED[:2] + JAPANESE
    want = brute_force(texts)
    rows = stuffing.scores(frame(spark, texts), "doc_id", "text").collect()
    assert len(rows) == len(texts)
    for r in rows:
        for name, x in want[r.doc_id].items():
            assert getattr(r, name) == (None if x is None else pytest.approx(x)), (name, texts[r.doc_id])


OTHER_LANGUAGES = [
    "Il contratto scade alla fine del mese e nessuno ha ancora risposto. Abbiamo chiesto due volte una copia firmata. Domani provo a chiamare di nuovo.",
    "Договор заканчивается в конце месяца, и никто пока не ответил. Мы два раза просили подписанную копию. Завтра я попробую позвонить ещё раз.",
    "Umowa wygasa pod koniec miesiąca i nikt jeszcze nie odpowiedział. Dwa razy prosiliśmy o podpisaną kopię. Jutro spróbuję zadzwonić ponownie.",
    "O contrato termina no fim do mês e ninguém respondeu ainda. Pedimos duas vezes uma cópia assinada. Amanhã vou tentar ligar de novo.",
    "Het contract loopt eind van de maand af en niemand heeft nog geantwoord. We hebben twee keer om een getekende kopie gevraagd. Morgen bel ik opnieuw.",
    "Sopimus päättyy kuun lopussa eikä kukaan ole vielä vastannut. Pyysimme kahdesti allekirjoitettua kopiota. Huomenna yritän soittaa uudelleen.",
    "ينتهي العقد في نهاية الشهر ولم يرد أحد بعد. طلبنا نسخة موقعة مرتين. سأحاول الاتصال مرة أخرى غدا.",
    "hợp đồng hết hạn vào cuối tháng và chưa ai trả lời chúng tôi đã hỏi hai lần ngày mai tôi sẽ gọi lại xem họ nói gì",
]


def test_other_languages_are_kept(spark):
    alone = stuffing.stuffed(frame(spark, OTHER_LANGUAGES), "doc_id", "text")
    assert alone.count() == 0
    among = frame(spark, OTHER_LANGUAGES + NATURAL + STUFFED)
    n = len(OTHER_LANGUAGES + NATURAL)
    assert {r.doc_id for r in stuffing.stuffed(among, "doc_id", "text").collect()} == set(range(n, n + len(STUFFED)))


def sentences(rnd, n):
    things, people, days = ["clause", "form", "letter", "annex", "list"], ["lawyer", "landlord", "tenant", "clerk"], ["monday", "friday", "sunday"]
    pick = rnd.choice
    return [
        f"The {pick(people)} wants a copy of the {pick(things)} before {pick(days)}. We have asked the {pick(people)} about it, and that is all that I know. "
        f"If the {pick(things)} is not there on {pick(days)}, then the {pick(people)} will have to write to the {pick(people)}."
        for _ in range(n)
    ]


def test_word_salad_with_function_words(spark):
    rnd = random.Random(3)
    plain = sentences(rnd, 200)
    words = sorted({w.strip(".,").lower() for t in plain for w in t.split()})
    salad = [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(3)]
    got = {r.doc_id: r for r in stuffing.scores(frame(spark, plain + salad), "doc_id", "text").collect()}
    assert {i for i, r in got.items() if r.salad} == {200, 201, 202}
    assert {r.doc_id for r in stuffing.stuffed(frame(spark, plain + salad), "doc_id", "text").collect()} == {200, 201, 202}


def test_words_that_keep_the_company_of_stuffing(spark):
    rnd = random.Random(4)
    tags = ["seobacklinks", "ndatemplate", "palletjack", "loanshop", "logodesign", "teaonline", "casinocode", "watchsale", "leaseform", "essaywriting", "forklift", "creditnow"]
    lists = [", ".join(rnd.sample(tags, 12)) for _ in range(10)]
    glued = " ".join(rnd.sample(tags, 12))
    plain = sentences(rnd, 30)
    got = {r.doc_id for r in stuffing.stuffed(frame(spark, plain + lists + [glued]), "doc_id", "text").collect()}
    assert got == set(range(30, 41))


def test_rows_with_one_key_are_judged_alone(spark):
    df = spark.createDataFrame([(1, STUFFED[0], "x"), (1, NATURAL[0], "x"), (None, STUFFED[1], "x")], "doc_id bigint, text string, share string")
    assert stuffing.scores(df, "doc_id", "text").count() == 3
    assert {r.doc_id for r in stuffing.stuffed(df, "doc_id", "text").collect()} == {1, None}


def test_folded_texts_are_read_back():
    for t in NATURAL + STUFFED + JAPANESE + OTHER_LANGUAGES:
        f = stuffing.fold(t or "")
        assert stuffing.Words.read(str(f), f.links, f.code) == f


def test_empty_and_long(spark):
    assert stuffing.stuffed(frame(spark, []), "doc_id", "text").count() == 0
    assert stuffing.stuffed(frame(spark, [None, ""]), "doc_id", "text").count() == 0
    assert [r.doc_id for r in stuffing.stuffed(frame(spark, ["watch replica sale " * 20_000]), "doc_id", "text").collect()] == [0]


JAPANESE = [
    "格安時計 通販 | 格安時計 販売 | 格安時計 激安 | 格安時計 最安 | 格安時計 送料無料 | 格安時計 通販",
    "ブランドコピー時計ブランドコピー時計ブランドコピー時計ブランドコピー時計ブランドコピー時計ブランドコピー時計ブランドコピー時計",
    "タグ：時計、財布、バッグ、おすすめ、激安、通販、格安、ブランド、送料無料、人気、ランキング、セール",
    "格安時計格安時計格安時計格安時計格安時計格安時計格安時計格安時計格安時計格安時計格安時計格安時計格安時計",
    "通販・激安\n" + "\n".join(f"時計 https://shop{i}.example/x" for i in range(6)),
]
PLAIN_JAPANESE = [
    "署名欄を先に確認した方がいいと思います。業者は納品日程に問題がないと言っています。第6条の納品日程を読み直してください。86日待っても保証内容の返事がありません。" * 3,
    "7月の雛形には古い更新条項が残っていました。ブランド時計の通販サイトで激安セールを見つけましたが、送料が高いので買うのをやめました。\nhttps://a.example/x\nhttps://b.example/y",
]


def test_japanese(spark):
    df = frame(spark, NATURAL + PLAIN_JAPANESE + JAPANESE)
    n = len(NATURAL + PLAIN_JAPANESE)
    assert {r.doc_id for r in stuffing.stuffed(df, "doc_id", "text").collect()} == set(range(n, n + len(JAPANESE)))


def test_unspaced():
    assert stuffing.unspaced("第22条の支払期限を") == ["第", "22", "条", "の", "支払期限", "を"] and stuffing.unspaced("おすすめ") == ["オススメ"]
    assert stuffing.unspaced("個人情報保護法") == ["個人", "情報", "保護", "法"] and stuffing.unspaced("時計店時計店") == ["時計店"] * 2
