"""Fixed values typed from the rules' source, apart from the tables that queries and their SQL share."""

from pyspark.sql import functions as F

from hostlens.functions import devices as d
from hostlens.plans import components as c

# Texts of some problem codes.
CODES = {
    0: "Работает нормально", 1: "Устройство настроено неправильно", 10: "Устройство не может запуститься", 14: "Требуется перезагрузка", 18: "Требуется переустановка драйверов", 22: "Устройство отключено",
    24: "Устройство отсутствует или не работает (нет драйверов)", 28: "Драйверы не установлены", 31: "Не удаётся загрузить нужные драйверы", 32: "Драйвер/служба отключены", 37: "Не удаётся инициализировать драйвер",
    39: "Не удаётся загрузить драйвер: повреждён или отсутствует", 43: "Windows остановила устройство из-за неполадок", 45: "Устройство сейчас не подключено", 48: "Запуск ПО заблокирован из-за известных проблем",
    52: "Не удаётся проверить цифровую подпись драйвера", 54: "Сбой; выполняется сброс", 55: "Код проблемы 55", -1: "Код проблемы -1",
}
HEALTH = {0: "Ok", 1: "NeedsDriver", 10: "Error", 14: "Error", 18: "NeedsDriver", 22: "Disabled", 24: "NotConnected", 28: "NeedsDriver", 31: "NeedsDriver", 32: "Disabled", 37: "NeedsDriver", 39: "NeedsDriver", 43: "Error", 45: "NotConnected", 48: "Disabled", 52: "NeedsDriver", 54: "Error", 55: "Error", -1: "Error"}


def test_problem_codes(spark):
    rows = spark.createDataFrame([(k,) for k in CODES], "code int")
    got = {r.code: (r.text, r.health) for r in rows.select("code", d.describe(F.col("code")).alias("text"), d.classify(F.col("code")).alias("health")).collect()}
    assert got == {k: (CODES[k], HEALTH[k]) for k in CODES}


def test_catalog(spark):
    rows = {r.component_key: r for r in c.catalog(spark).collect()}
    assert list(rows) == ["vcredist_x64", "vcredist_x86", "directx", "dotnet8_desktop"]
    assert [r.recommended for r in rows.values()] == [True, True, True, False]
    assert [r.success_exit_codes for r in rows.values()] == [[0, 3010, 1638, 1641], [0, 3010, 1638, 1641], [0], [0, 3010, 1638]]
    assert [r.file_name for r in rows.values()] == ["vc_redist.x64.exe", "vc_redist.x86.exe", "dxwebsetup.exe", "windowsdesktop-runtime-8-x64.exe"]
