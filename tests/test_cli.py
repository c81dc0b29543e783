from sparklog.__main__ import main


def test_list_export_errors(capsys, tmp_path):
    assert main(["-l"]) == 0 and "serilog      " in capsys.readouterr().out
    assert main(["-e", "dmesg"]) == 0 and "entry: [%{time}] %{message}" in capsys.readouterr().out
    assert main(["-e", "nope"]) == 2


def test_print(spark, capsys, tmp_path):
    p = tmp_path / "a.log"
    p.write_bytes(b"2026-01-01 00:00:00,000 - a - ERROR - x\r\n  trace\n2026-01-01 00:00:01,000 - a - INFO - y")
    assert main([str(p), "-f", "level == ERROR"]) == 0
    assert capsys.readouterr().out == "2026-01-01 00:00:00,000 - a - ERROR - x\n  trace\n"
    assert main([str(p), "-t", "python", "-f", "nope == 1"]) == 2
    assert main([str(tmp_path / "b.log")]) == 1
    assert main([str(p), "-w", "mine"]) == 0 and "name: mine" in capsys.readouterr().out
