"""Default vocabularies. Every operator that uses one takes it as a parameter."""

from __future__ import annotations

import dataclasses

# Query parameters that don't identify a page.
TRACKING_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid", "ref")

# Words that tokens leave out.
STOPWORDS = (
    "the", "a", "an", "of", "in", "on", "for", "to", "and", "or", "as", "at", "by", "with", "from", "is", "are", "was", "were",
    "be", "been", "its", "his", "her", "their", "this", "that", "after", "over", "into", "amid", "says", "said", "new",
)

# Entities and their aliases.
ENTITIES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("美国", ("United States", "U.S.", "USA", "America", "Washington", "White House", "Pentagon", "美国", "华盛顿", "白宫", "五角大楼")),
    ("中国", ("China", "Chinese", "Beijing", "中国", "北京")),
    ("俄罗斯", ("Russia", "Russian", "Moscow", "Kremlin", "俄罗斯", "莫斯科", "克里姆林宫")),
    ("日本", ("Japan", "Japanese", "Tokyo", "日本", "东京")),
    ("韩国", ("South Korea", "Seoul", "韩国", "首尔")),
    ("朝鲜", ("North Korea", "Pyongyang", "朝鲜", "平壤")),
    ("印度", ("India", "Indian", "New Delhi", "印度", "新德里")),
    ("巴基斯坦", ("Pakistan", "巴基斯坦")),
    ("伊朗", ("Iran", "Iranian", "Tehran", "伊朗", "德黑兰")),
    ("以色列", ("Israel", "Israeli", "Jerusalem", "以色列", "耶路撒冷")),
    ("巴勒斯坦", ("Palestine", "Palestinian", "Gaza", "West Bank", "巴勒斯坦", "加沙", "约旦河西岸")),
    ("沙特阿拉伯", ("Saudi Arabia", "Riyadh", "沙特", "利雅得")),
    ("土耳其", ("Turkey", "Turkiye", "Ankara", "Istanbul", "土耳其", "安卡拉", "伊斯坦布尔")),
    ("乌克兰", ("Ukraine", "Ukrainian", "Kyiv", "乌克兰", "基辅")),
    ("德国", ("Germany", "German", "Berlin", "德国", "柏林")),
    ("法国", ("France", "French", "Paris", "法国", "巴黎")),
    ("英国", ("United Kingdom", "UK", "Britain", "London", "英国", "伦敦")),
    ("欧盟", ("European Union", "EU", "Brussels", "欧盟", "布鲁塞尔")),
    ("北约", ("NATO", "北约")),
    ("联合国", ("United Nations", "U.N.", "UN", "联合国")),
    ("台湾地区", ("Taiwan", "台湾")),
    ("香港", ("Hong Kong", "香港")),
    ("东盟", ("ASEAN", "东盟", "东南亚国家联盟")),
    ("澳大利亚", ("Australia", "Canberra", "澳大利亚", "堪培拉")),
    ("加拿大", ("Canada", "Ottawa", "加拿大", "渥太华")),
    ("巴西", ("Brazil", "Brasilia", "巴西", "巴西利亚")),
    ("墨西哥", ("Mexico", "墨西哥")),
    ("阿根廷", ("Argentina", "Buenos Aires", "阿根廷", "布宜诺斯艾利斯")),
    ("南非", ("South Africa", "Pretoria", "南非")),
    ("埃及", ("Egypt", "Cairo", "埃及", "开罗")),
    ("尼日利亚", ("Nigeria", "Abuja", "尼日利亚")),
    ("埃塞俄比亚", ("Ethiopia", "Addis Ababa", "埃塞俄比亚")),
    ("印尼", ("Indonesia", "Jakarta", "印度尼西亚", "雅加达")),
    ("越南", ("Vietnam", "Hanoi", "越南", "河内")),
    ("泰国", ("Thailand", "Bangkok", "泰国", "曼谷")),
    ("缅甸", ("Myanmar", "Burma", "Naypyidaw", "缅甸")),
    ("菲律宾", ("Philippines", "Manila", "菲律宾", "马尼拉")),
    ("马来西亚", ("Malaysia", "Kuala Lumpur", "马来西亚", "吉隆坡")),
    ("新加坡", ("Singapore", "新加坡")),
)

# Topics in order of priority, and their keywords.
TOPICS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("military", ("war", "missile", "airstrike", "air strike", "troops", "military", "attack", "drone strike", "nuclear", "军队", "战争", "导弹", "空袭", "袭击", "军演", "部队", "核武", "无人机", "军方")),
    ("diplomacy", ("summit", "diplomatic talks", "sanction", "ambassador", "treaty", "diplomat", "foreign minister", "会谈", "峰会", "制裁", "大使", "外交", "外长", "访问", "协议", "断交")),
    ("economy", ("economy", "trade", "tariff", "market", "inflation", "oil price", "energy", "chip", "semiconductor", "export", "import", "gdp", "central bank", "经济", "贸易", "关税", "市场", "通胀", "石油", "能源", "芯片", "半导体", "出口", "进口", "央行")),
    ("tech", ("artificial intelligence", "technology", "satellite", "cyber", "quantum", "人工智能", "科技", "卫星", "网络攻击", "量子")),
    ("politics", ("election", "president", "parliament", "government", "protest", "prime minister", "coup", "选举", "总统", "议会", "政府", "抗议", "总理", "政变", "执政")),
    ("society", ("earthquake", "flood", "wildfire", "epidemic", "migrant crisis", "学校", "健康", "气候", "地震", "洪水", "山火", "移民潮")),
)

# Severities in order of priority, and their keywords.
SEVERITIES: tuple[tuple[float, tuple[str, ...]], ...] = (
    (1.8, ("war", "invade", "missile strike", "nuclear", "coup", "killed", "dead", "战争", "入侵", "导弹袭击", "核", "政变", "遇难", "身亡")),
    (1.4, ("sanction", "state of emergency", "resign", "air strike", "attack", "export control", "制裁", "紧急状态", "辞职", "空袭", "袭击", "出口管制")),
    (1.15, ("summit", "election", "tariff", "protest", "trade deal", "峰会", "选举", "关税", "抗议", "贸易协议")),
)

# The brief's wording.
IMPACTS: tuple[tuple[float, str], ...] = ((1.6, "高重要性事件，建议持续跟踪后续发展与各方回应。"), (1.3, "重要性较高，关注事态走向与关联各方表态。"))
IMPACT_OTHER = "常规动态，纳入背景观察。"
TOPIC_LABELS = {"military": "军事", "diplomacy": "外交", "economy": "经济", "tech": "科技", "politics": "政治", "society": "社会", "other": "综合"}
RELATION_LABELS = {"causal": "前因", "escalation": "升级", "de_escalation": "缓和", "response": "回应", "background": "背景", "same_actor": "同一行为体", "thematic_parallel": "同题平行"}


@dataclasses.dataclass(frozen=True)
class Rules:
    """A keyword lexicon: topics and severities in order of priority."""

    topics: tuple[tuple[str, tuple[str, ...]], ...] = TOPICS
    severities: tuple[tuple[float, tuple[str, ...]], ...] = SEVERITIES
