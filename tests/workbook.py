"""A minimal workbook writer for tests."""

import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def letters(index):
    out = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


def write_workbook(path, rows):
    """``rows`` are (number, cells); texts go to the shared strings, every third one inline."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    shared, lines, n_texts = [], [], 0
    for number, cells in rows:
        xml = []
        for i, value in enumerate(cells):
            ref = f"{letters(i)}{number + 1}"
            if value is None:
                continue
            if isinstance(value, str):
                n_texts += 1
                if n_texts % 3 == 0:
                    xml.append(f'<c r="{ref}" t="inlineStr"><is><t>{escape(value)}</t></is></c>')
                else:
                    shared.append(value)
                    xml.append(f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>')
            else:
                xml.append(f'<c r="{ref}"><v>{value}</v></c>')
        lines.append(f'<row r="{number + 1}">{"".join(xml)}</row>')
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml",
                      f'<worksheet xmlns="{MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
        texts = "".join(f"<si><t>{escape(s)}</t></si>" for s in shared)
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{texts}</sst>')
