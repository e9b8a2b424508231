import subprocess
import sys
import textwrap
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_names_match(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_imports_without_the_llm_folders(tmp_path):
    """The rest of the library stands alone."""
    code = textwrap.dedent(
        f"""
        import shutil, sys
        shutil.copytree({str(ROOT / "quillon")!r}, {str(tmp_path / "quillon")!r}, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy({str(ROOT / "__spark_entry__.py")!r}, {str(tmp_path)!r})
        sys.path[:] = [{str(tmp_path)!r}] + [p for p in sys.path if p not in ("", {str(ROOT)!r})]
        import __spark_entry__ as e
        names = e.queries()
        assert names and not [n for n in names if n.startswith("op") or n == "pipeline"], names
        """
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, timeout=120)
