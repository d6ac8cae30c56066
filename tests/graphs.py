"""Small graphs that tests share (fixed values)."""

DS1 = "1 2;1 5;1 6;2 3;3 4;4 8;5 6;5 7;6 8;8 8"
DS2 = "1 2;2 6;3 6;6 4;5 3;6 1;11 2;9 11;9 12;10 11;10 8;8 7;3 8;13 14"
DS3 = "0 1;1 2;3 2;2 4;4 5;6 5"


def lines(text, path):
    path.write_text(text.replace(";", "\n") + "\n")
    return str(path)
