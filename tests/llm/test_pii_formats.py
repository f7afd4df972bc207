"""Recall of personal data on phrasings and formats that the trees are not fitted on, written by hand."""

from test_span_operators import frame

from corvane.llm import pii

PERSONAL = {
    "email": [
        "You can get hold of jane AT example DOT com after lunch.", "Questions go to the desk: support [AT] northwind [DOT] info, thanks", "her handle there is p.okafor (at) lakeside (dot) nl and she answers",
        "Bewerbung an personal(at)musterfirma.de bis Freitag", "mail: k_lind @ fjord.ch", "please send it to tom.h @ riverbank . org today", "j.smith{at}college{dot}edu wrote the paper", "copy anna-lena at kontor dot eu on this",
        "E-mail him, dario <at> bottega <dot> it", "contact: ops @ intranet",
    ],
    "ip": [
        "The trace ended at 2001:db8::8a2e:370:7334 twice.", "link-local fe80::1 answered", "router fe80::2aa:ff:fe9a:4ca2%eth0 is down", "blocked 2a00:1450:4001:81b::200e after ten tries", "Peer ::ffff:c000:280 joined",
        "AAAA record 2606:2800:220:1:248:1893:25c8:1946 expired", "gateway=2001:4860:4860::8888", "resolved to FD12:3456:789A::1.", "subnet 2001:db8:85a3::/64 was given", "listening on 2001:0DB8:AC10:FE01::",
    ],
    "card": [
        "He read out 3782.822463.10005 over the line.", "the Amex is 3714/496353/98431, billed monthly", "4111.1111.1111.1111 was declined", "charged to 5555_5555_5555_4444 in May", "number: 6011/1111/1111/1117.",
        "Diners 3056.930902.5904 please", "my plastic, 4012\u20138888\u20138888\u20131881, expired", "Kreditkarte 5105  1051  0510  5100", "use 3787\u2013344936\u201371000", "on file: 4222.2222.2222.2220",
    ],
    "phone": [
        "tel. 01 23 45 67 89", "call 030 1234567", "Rufen Sie an: 089/1234567", "Mobil 0171 2345678 bis acht", "joignable au 06.12.34.56.78 le soir", "her desk is (020) 7946 0958", "ring me on 07700 900123", "dial 1-800-555-0199 now",
        "WhatsApp 612 34 56 78", "Switzerland: phone 044 668 18 00", "my number is 4155550132", "from abroad 0033 1 23 45 67 89", "fax (0221) 4710123",
    ],
}
#: Written after the templates were settled on, and never used to change them.
LATER = {
    "email": ["Feedback welcome at hello AT greenfield DOT co", "(maria.silva [at] casa-azul [dot] es)", "cc: ruben @ okeanos.io", "written by d.novak at praha dot net for us", "l.chen{at}harbor{dot}org, third floor"],
    "ip": ["ssh to 2a01:4f8:c17:b0f::2 failed", "dropped packet from fe80::cafe:1", "ns1 has 2620:fe::fe set", "src 2001:470:1f0b:7b5:0:0:0:2 dst local", "sent via 2a03:2880:f12f:83:face:b00c:0:25de"],
    "card": ["Billing uses 3714.496353.98431", "he paid by 4000/0566/5566/5556 yesterday", "numbered 5200.8282.8282.8210,", "3852_000002_3237 is a test one", "kept 3782/822463/10005 in notes"],
    "phone": ["Sprechstunde unter 0511 9876543", "le 02 98 76 54 32 est occupe", "the clinic, (0131) 496 0123", "sms 07911 123456", "office phone 91 123 45 67", "desk: 212-555-0147", "cell 2125550147 for emergencies"],
}
CLEAN = [
    "We met at the river. Then we left at noon.", "version 10.4.2 of build 20240115", "std::vector and abc::def are names", "order 123 456 789 shipped", "see page 12 34", "between 1990 and 2005 it rose by 12.5 percent",
    "ISBN 978-3-16-148410-0 of the book", "look at maple.txt first", "ten @ 4.50 each", "ticket 8841923355 was closed", "ratio 3::4 of the mix", "born 12.05.1984 in Rome", "sum 1 234 567 890 in total", "serial 00:11:22:33:44:55:66:77",
]


def found(spark, texts):
    rows = {r.doc_id: r["__cv_spans"] for r in pii.personal_data(frame(spark, texts)).collect()}
    return [[(s.kind, texts[i][s.start : s.end]) for s in rows[i]] for i in range(len(texts))]


def test_formats_and_phrasings_not_fitted_on(spark):
    every = [(k, t) for k, ts in PERSONAL.items() for t in ts]
    got = found(spark, [t for _, t in every])
    missed = [(k, t) for (k, t), spans in zip(every, got, strict=True) if not any(kind == k for kind, _ in spans)]
    for k, ts in PERSONAL.items():
        print(k, len(ts) - sum(m[0] == k for m in missed), "of", len(ts))
    assert len(missed) <= 0.1 * len(every), missed


def test_formats_written_later(spark):
    every = [(k, t) for k, ts in LATER.items() for t in ts]
    got = found(spark, [t for _, t in every])
    missed = [(k, t) for (k, t), spans in zip(every, got, strict=True) if not any(kind == k for kind, _ in spans)]
    print("later", len(every) - len(missed), "of", len(every))
    assert len(missed) <= 0.1 * len(every), missed


def test_clean_texts_stay_clean(spark):
    got = found(spark, CLEAN)
    assert sum(bool(s) for s in got) <= 1, [(t, s) for t, s in zip(CLEAN, got, strict=True) if s]
