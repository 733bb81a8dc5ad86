import re

from docgraph.operators import structure as S

NAMES = {"CHƯƠNG": "CHUONG", "MỤC": "MUC", "ĐIỀU": "DIEU", "KHOẢN": "KHOAN", "ĐIỂM": "DIEM", "PHỤ LỤC": "PHU_LUC"}


def brute(text):
    found, open_ = [], {}
    for i, line in enumerate(re.split(r"\r\n|\r|\n", text)):
        line = line.strip()
        if not line:
            continue
        m = re.match(r"(?i)^(Chương|Mục|Điều|Khoản|Điểm|Phụ\s*lục)\s+([^.\-:]+)(?:[.\-:]\s*(.*))?$", line)
        if not m:
            if not found:
                found.append([-1, "PREAMBLE", None, None, "Mở đầu", []])
            found[-1][5].append(line)
            continue
        unit = NAMES[re.sub(r"\s+", " ", m[1].upper())]
        for gone in S.RESETS[unit]:
            open_.pop(gone, None)
        shown = " ".join(w.capitalize() for w in m[1].split(" "))
        open_[unit] = f"{shown} {m[2].strip()}"
        location = ", ".join(open_[u] for u in S.UNITS if u in open_)
        found.append([i, unit, m[2].strip(), (m[3] or "").strip() or None, location, []])
    return [(o, u, label, t, where, "\n".join(body) or where) for o, u, label, t, where, body in found]


def test_sections_equal_brute_force(spark):
    texts = [
        "mở đầu\n\n  hai dòng  \nChương I. Chung\nĐiều 1. Phạm vi\na\r\nb\rKhoản 1: x\nĐiểm a - y\nnội dung\nKhoản 2\nĐiều 2\nMục 3. m\nĐiều 3\nPhụ lục 1. p\nKhoản 9\nhết",
        "", "   \n\t\n", "chỉ có lời", "Điều 5", "ĐIỀU 6. HOA\nkhoản 7. thường\nPhụ  lục 2", "Điều luật này\nĐiềukhông phải",
        "\n".join(f"Điều {k}. Tên {k}\n" + "\n".join(f"dòng {j}" for j in range(k % 4)) for k in range(400)), "x\n" * 5_000 + "Khoản 1. a\n" + "y\n" * 3,
    ]
    rows = [(f"v{i}", t) for i, t in enumerate(texts)] + [("null", None)]
    got = {}
    for r in S.legal_locations(spark.createDataFrame(rows, "version_id string, raw_text string").repartition(3)).orderBy("version_id", "ord").collect():
        got.setdefault(r["version_id"], []).append((r["ord"], r["section_type"], r["label"], r["title"], r["legal_location"], r["content"]))
    assert got == {k: brute(t) for k, t in rows if t is not None and brute(t)}
