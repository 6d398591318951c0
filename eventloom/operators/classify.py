"""Rule-based classes of phrases, sentences and keywords: the first rule one of whose words the lower-cased text contains."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.semantics import once
from .normalise import PREFECTURES

# Words that decide a class, in order of the rules. They can be replaced by rules of the caller's own.
CITIES = "札幌 仙台 名古屋 神戸 福岡市 横浜 川崎 渋谷 新宿 池袋 秋葉原 品川 丸の内 六本木 梅田 難波 天神 博多 中洲 栄 金山".split()
REGIONS = "関東 関西 東海 九州 北陸 中国 四国 東北 首都圏 近畿 中部 山陰 山陽".split()
PLACES = [*PREFECTURES, *CITIES, *REGIONS]
ONLINE = ["オンライン", "リモート", "配信", "ウェビナー", "zoom開催"]
LANGUAGES = "python javascript typescript java c# golang rust swift kotlin php ruby scala dart elixir".split()
STORES = "postgresql mysql mongodb redis elasticsearch aws azure gcp docker kubernetes terraform".split()
PROTOCOLS = "api rest graphql websocket grpc".split()

PHRASE_NOISE = (
    ["vscode", "vs code", "visual studio code", "zoom", "gmail", "slack", "notion", "figma", "pc", "パソコン", "インストール", "ダウンロード"]
    + "申し込み 案内 準備 用意 アカウント 早稲田大学 慶應大学 東京大学 大学 株式会社 有限会社 i-mode chrome safari firefox excel word powerpoint".split()
)
PHRASE_TECHNOLOGY = [
    *LANGUAGES, *"react vue angular svelte next.js nuxt.js express fastapi django flask spring laravel rails".split(), *STORES,
    *"chatgpt gpt openai gemini claude ai 機械学習 ml llm".split(), *PROTOCOLS,
    *"if文 for文 関数 リスト 辞書 クラス オブジェクト アルゴリズム データ構造 非同期 並行処理".split(),
]
PHRASE_SKILL = (
    "学習 習得 解説 解決 デバッグ エラー解決 コード プログラミング コーディング 開発 実装 設計 1行ずつ 共有 体験 実践 手法 方法 スキル 効率 最適化 "
    "リファクタリング レビュー テスト ペアプログラミング チーム開発 アジャイル スクラム"
).split()
PHRASE_FEATURE = (
    "講座 セミナー ワークショップ 研修 勉強会 ハンズオン 初心者 中級者 上級者 未経験 入門 基礎 応用 オフライン 対面 無料 有料 テックジム アカデミー "
    "スクール ブートキャンプ 中学生 高校生 学生 社会人 シニア"
).split()
PHRASE_RULES = [("other", PHRASE_NOISE), ("location", PLACES), ("technology", PHRASE_TECHNOLOGY), ("skill", PHRASE_SKILL), ("feature", PHRASE_FEATURE)]
PHRASE_WEIGHTS = {"location": 0.0, "technology": 1.5, "skill": 1.2, "feature": 0.9, "other": 0.5}

SENTENCE_NOISE = (
    "gmail zoom pc パソコン インストール 申し込み 案内 用意 準備 ご用意 アカウント ダウンロード 設定 早稲田大学 慶應大学 東京大学 大学 学部 研究室 大学院 "
    "教授 准教授 株式会社 有限会社 合同会社 i-mode"
).split()
SENTENCE_LEVEL = (
    "初心者 初学者 未経験 経験者 中級者 上級者 初級 中学生 高校生 学生 社会人 シニア 対象者 レベル 基礎知識なし 基礎知識 予備知識 前提知識 スキルレベル "
    "難易度 習熟度 経験年数 年齢 世代 以上"
).split()
SENTENCE_CREDIT = "創業 起業 設立 開発経験 実績 経験年数 キャリア ダウンロード 突破 万人 参加者 育成 送り込む 開発現場 現場経験 プロジェクト チーム リーダー".split()
SENTENCE_TECHNICAL = (
    "python javascript react vue api データベース アルゴリズム フレームワーク ライブラリ コード プログラミング 開発 実装 設計 アーキテクチャ インフラ aws "
    "docker kubernetes 関数 if文 for文 リスト 辞書 変数 配列 オブジェクト デバッグ エラー 文法 構文 仕様"
).split()
SENTENCE_SUMMARY = (
    "講座 セミナー ワークショップ 研修 概要 内容 目的 目標 特徴 メリット 効果 結果 成果 方式 メソッド カリキュラム テックジム 効率 暗記不要 実績 創業 育成"
).split()
SENTENCE_ACTION = "参加 体験 学習 習得 実践 挑戦 取り組み 活用 利用 受講 参加者 手を動かす 一緒に 解説 指導 サポート".split()
SENTENCE_RULES = [
    ("actionable", SENTENCE_NOISE), ("contextual", SENTENCE_LEVEL), ("contextual", SENTENCE_CREDIT), ("technical", SENTENCE_TECHNICAL),
    ("summary", SENTENCE_SUMMARY), ("actionable", SENTENCE_ACTION),
]
SENTENCE_WEIGHTS = {"summary": 1.4, "technical": 1.2, "contextual": 1.1, "actionable": 0.6}

KEYWORD_NOISE = (
    "gmail zoom pc vscode chrome safari インストール ダウンロード 申し込み 案内 準備 株式会社 有限会社 i-mode アカウント 東京 大阪 渋谷 新宿 関東 関西 "
    "開催地 会場 関数 function if文 for文 while文 リスト list 辞書 dict クラス class オブジェクト object 変数 配列 array ループ 条件分岐 メソッド "
    "インスタンス 学習法 学習方法 効率学習 実践学習 効率的学習 効率的 効率 実践 体験 基礎 入門 習得"
).split()
KEYWORD_LEVEL = "初心者 初学者 未経験 中級者 上級者 入門 基礎 応用 中学生 高校生 学生 社会人 シニア レベル 難易度 対象者 前提知識".split()
KEYWORD_TECHNOLOGY = [
    *"chatgpt gpt openai gemini claude ai 人工知能 機械学習 深層学習 ディープラーニング ml dl llm チャットgpt チャット 生成ai".split(), *LANGUAGES, "パイソン",
    *"react vue angular svelte nextjs nuxtjs express fastapi django flask spring laravel rails".split(), *STORES, *PROTOCOLS, *"json http アルゴリズム データ構造".split(),
]
KEYWORD_SKILL = "解説 解決 デバッグ エラー解決 コード コーディング 開発 実装 設計 共有 最適化 テスト レビュー リファクタリング".split()
KEYWORD_CONCEPT = "テックジム プログラミング アジャイル スクラム ペアプログラミング チーム開発 リファクタリング アーキテクチャ フレームワーク ライブラリ メソッド".split()
KEYWORD_RULES = [
    ("other", KEYWORD_NOISE), ("location", PLACES), ("level", KEYWORD_LEVEL), ("technology", KEYWORD_TECHNOLOGY), ("skill", KEYWORD_SKILL), ("concept", KEYWORD_CONCEPT),
]
KEYWORD_WEIGHTS = {"location": 0.0, "technology": 1.8, "concept": 1.3, "skill": 1.0, "level": 1.1, "other": 0.2}

TECH_TERMS = [
    r"Python|Java|JavaScript|PHP|Ruby|Go|Rust|C\+\+|HTML|CSS", "ChatGPT|GPT|AI|機械学習|データサイエンス|深層学習", r"React|Vue|Angular|Node\.js|Django|Flask|Laravel",
    "AWS|Azure|GCP|Docker|Kubernetes|Git|GitHub", "プログラミング|コーディング|開発|エンジニア|システム",
]

#: First characters that are compared one after another.
FIRST = 5


def any_of(words: Iterable[str]) -> str:
    """A regular expression for texts that contain one of the words. Words with a common beginning share it, and words that
    contain another one are left out, so that a place in a text is compared with some first characters, not with each word."""
    words, tree = set(words), {}
    for w in sorted(x for x in words if not any(y != x and y in x for y in words)):
        at = tree
        for c in w:
            at = at.setdefault(c, {})

    def branches(at: dict, chars: Iterable[str]) -> str:
        found = [("\\" + c if not (c.isalnum() or ord(c) > 127 or c in " -") else c) + (branches(at[c], at[c]) if at[c] else "") for c in chars]
        return found[0] if len(found) == 1 else f"(?:{'|'.join(found)})"

    ascii_, others = (sorted(c for c in tree if (ord(c) < 128) == few) for few in (True, False))
    groups = [ascii_[i : i + FIRST] for i in range(0, len(ascii_), FIRST)]
    found = [rf"(?=[\x{{{ord(g[0]):x}}}-\x{{{ord(g[-1]):x}}}]){branches(tree, g)}" for g in groups]
    return "|".join([*found, *([rf"(?=[^\x00-\x7F]){branches(tree, others)}"] if others else [])])


def matches_any(lowered: Column, words: Iterable[str]) -> Column:
    """One scan of the text for all words."""
    return F.coalesce(lowered.rlike(any_of(words)), F.lit(False))


def by_rules(text: Column, rules, default: str) -> Column:
    """The label of the first rule that fits. A text without any rule's word, as most are, is scanned once."""

    def labelled(lowered: Column) -> Column:
        out = None
        for label, words in rules:
            hit = matches_any(lowered, words)
            if words is PLACES and rules is PHRASE_RULES:
                hit = hit & ~matches_any(lowered, ONLINE)  # what is held online has no place
            out = F.when(hit, label) if out is None else out.when(hit, label)
        return F.when(matches_any(lowered, {w for _, words in rules for w in words}), out.otherwise(default)).otherwise(default)

    return once(F.lower(text), labelled)


def phrase_category(text: Column) -> Column:
    return by_rules(text, PHRASE_RULES, "other")


def sentence_type(text: Column) -> Column:
    return by_rules(text, SENTENCE_RULES, "contextual")


def keyword_category(text: Column) -> Column:
    return by_rules(text, KEYWORD_RULES, "other")


def weight(label: Column, weights: dict[str, float], missing: float, strict_zero: bool = False) -> Column:
    """A class's weight. As executed, a weight of 0 counts as missing; strict_zero keeps it."""
    values = [F.lit(v) for name, x in weights.items() for v in (name, float(x) if x or strict_zero else float(missing))]
    return F.coalesce(F.try_element_at(F.create_map(*values), label), F.lit(float(missing)))


def tech_terms(text: Column) -> Column:
    """Technical terms in the text, lower-cased, once each, pattern by pattern."""
    found = [F.regexp_extract_all(text, F.lit(f"(?i)(?:{p})"), F.lit(0)) for p in TECH_TERMS]
    return F.array_distinct(F.transform(F.concat(*found), F.lower))
