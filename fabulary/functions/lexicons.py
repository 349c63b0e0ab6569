"""The word lists and tables that the measures count. Every operator takes them as parameters."""

from __future__ import annotations

# Fixed values, in their given order.
CONFLICT_TERMS: dict[str, list[str]] = {
    "interpersonal": """
        冲突 对抗 战斗 打斗 打架 攻击 袭击 进攻 反击 厮杀 搏斗 决斗 较量 争吵 争执 吵架 辱骂 威胁 恐吓 敌对 敌人 仇恨 怨恨 复仇 报复 背叛 欺骗 陷害 阴谋 决裂 翻脸 追杀 围剿
        战争 开战 交火 对峙 谈判 官司 诉讼 指控
    """.split(),
    "internal": """
        矛盾 犹豫 挣扎 纠结 两难 左右为难 进退两难 抉择 恐惧 害怕 畏惧 焦虑 担忧 不安 怀疑 自责 愧疚 后悔 悔恨 煎熬 折磨 痛苦 绝望 崩溃 动摇 孤独 迷茫 困惑 内心
    """.split(),
    "societal": """
        压迫 剥削 歧视 偏见 不公 反抗 抗议 起义 暴动 革命 罢工 游行 镇压 逮捕 监禁 囚禁 流放 驱逐 审判 犯罪 罪行 阶级 排挤 孤立 羞辱 嘲笑 蔑视
    """.split(),
    "survival": """
        风暴 暴雨 洪水 火灾 地震 雪崩 山崩 饥荒 瘟疫 疾病 中毒 溺水 受伤 伤口 流血 饥饿 严寒 寒冷 酷暑 疲惫 坠落 悬崖 绝境 困境 危险 危机 野兽 猛兽 荒野 沙漠 窒息 生存 求生
        逃命 逃生
    """.split(),
}
ENVIRONMENT_TERMS: list[str] = """
    房间 屋子 屋里 屋内 客厅 厨房 卧室 书房 门口 走廊 楼梯 电梯 院子 窗户 窗外 窗边 阳台 桌子 椅子 沙发 地板 墙壁 墙面 屋顶 天花板 灯光 烛光 台灯 街道 马路 巷子 胡同 路口
    人行道 广场 公园 车站 码头 机场 教室 操场 医院 商店 店铺 市场 工厂 车间 仓库 办公室 会议室 酒店 旅馆 餐馆 酒吧 银行 城墙 铁路 铁轨 山上 山下 山坡 森林 树林 树木 草地 草原
    田野 田间 河边 湖面 湖边 海边 海岸 沙滩 泥土 灰尘 花朵 树叶 枝条 雾气 阳光 光线 月光 星光 夜色 夜幕 黑暗 阴影 晨曦 清晨 早晨 黄昏 傍晚 深夜 午夜 雨水 雷雨 雪花 积雪 寒风
    大风 风声 乌云 雷声 寒冷 炎热 潮湿 干燥
""".split()
HEDGING: list[str] = """
    似乎 好像 仿佛 或许 也许 大概 可能 想来 据说 听说 怕是 有点
""".split()
ASSERTIVE: list[str] = """
    一定 必然 肯定 显然 确实 无疑 正是 根本 完全 绝对 向来 从来
""".split()
ADVERB_STOP_WORDS: list[str] = """
    的 了 着 地 得 之 其 此 该 这 那 是 在 有 和 与 或 及 而 但 并 就 都 也 不 没 未 无 非 别 莫 又 再 才 便 即 则 若 如 为 以 于 对 把 被 让 向 从 自 由 往 朝
    给 因 所以 因为 如果 虽然 但是 然而 于是 因此 而且 或者 以及 并且 还是 从而 进而
""".split()
PHRASE_STOP_POS: list[str] = """
    PU P CC DT PN M SP BA DEC CD OD CS MSP ETC NOI ADD DER FW URL SB DEV AS DEG -LRB- -RRB- ,
""".split()
THEME_STOP_TERMS: list[str] = """
    什么 这个 那个 一个 时候 东西 事情 问题 自己 这里 那里 一样 一切 所有 没有 可能 方式 部分 方面 作用 情况 一样东西
""".split()
SOLAR_TERMS: list[str] = """
    立春 雨水 惊蛰 春分 清明 谷雨 立夏 小满 芒种 夏至 小暑 大暑 立秋 处暑 白露 秋分 寒露 霜降 立冬 小雪 大雪 冬至 小寒 大寒
""".split()
FESTIVALS: list[str] = """
    除夕 春节 大年初一 正月十五 元宵 上元 寒食 端午 端阳 七夕 中元 中秋 仲秋 重阳 重九 腊八 寒衣 下元 元旦
""".split()
HOUR_PERIODS: list[str] = """
    子时 丑时 寅时 卯时 辰时 巳时 午时 未时 申时 酉时 戌时 亥时 三更 四更 五更 一更
""".split()
WEEKDAYS: list[str] = """
    周一 周二 周三 周四 周五 周六 周日 周天 周末 星期一 星期二 星期三 星期四 星期五 星期六 星期天 星期日 礼拜一 礼拜二 礼拜三 礼拜四 礼拜五 礼拜六 礼拜天
""".split()
DEICTIC_DAYS: dict[str, float] = {
    "第二天": 1.0, "前一天": -1.0, "上个月": -30.0, "半个月": 15.0, "今天": 0.0, "明天": 1.0, "次日": 1.0,
    "翌日": 1.0, "隔天": 1.0, "后天": 2.0, "昨天": -1.0, "昨日": -1.0, "前天": -2.0, "今年": 0.0, "明年": 365.0,
    "次年": 365.0, "去年": -365.0, "上月": -30.0, "本月": 0.0, "下周": 7.0, "上周": -7.0,
}
VAGUE_TIMES: dict[str, str] = {
    "春天": "season", "春季": "season", "初春": "season", "早春": "season", "夏天": "season",
    "夏季": "season", "盛夏": "season", "秋天": "season", "秋季": "season", "深秋": "season",
    "冬天": "season", "冬季": "season", "初冬": "season", "隆冬": "season", "凌晨": "time_of_day",
    "清晨": "time_of_day", "早晨": "time_of_day", "早上": "time_of_day", "上午": "time_of_day",
    "中午": "time_of_day", "正午": "time_of_day", "午后": "time_of_day", "下午": "time_of_day",
    "傍晚": "time_of_day", "黄昏": "time_of_day", "入夜": "time_of_day", "夜里": "time_of_day",
    "夜晚": "time_of_day", "深夜": "time_of_day", "午夜": "time_of_day", "半夜": "time_of_day",
    "多年以后": "deictic", "很久以后": "deictic", "许多年后": "deictic", "若干年后": "deictic",
    "片刻之后": "deictic", "与此同时": "deictic", "同一时间": "deictic", "那天": "deictic",
    "当天": "deictic", "那年": "deictic", "那晚": "deictic", "此刻": "deictic", "此时": "deictic",
    "当时": "deictic",
}
MARKS: list[tuple[str, str]] = [
    ("，", "逗号"), ("。", "句号"), ("、", "顿号"), ("；", "分号"), ("：", "冒号"), ("？", "问号"), ("！", "叹号"),
    ("…", "省略号"), ("—", "破折号"), ("“", "前引号"), ("”", "后引号"), ("「", "日式引号"), ("（", "括号"),
    ("《", "书名号"),
]
FUNCTION_GROUPS: list[tuple[str, str]] = [
    ("结构助词", "的地得"),
    ("动态助词", "了着过"),
    ("并列与转折", "和与及而但却"),
    ("副词", "很太更最就都也还又才只"),
    ("把与被", "把被"),
    ("文言虚词", "之其者乃则亦乎"),
]
PERSONS: dict[str, str] = {"first": "我咱俺", "second": "你您", "third": "他她它"}
PRONOUN_BLOCK_BEFORE = "其别单"
#: (pattern, category)
STOCK_PHRASES: list[tuple[str, str]] = [
    ("微微一笑", "expression"),
    ("(淡淡|浅浅)一笑", "expression"),
    ("嘴角勾起", "expression"),
    ("嘴角(微微)?(上扬|翘起)", "expression"),
    ("一抹弧度", "expression"),
    ("挑了挑眉", "expression"),
    ("眉头(微|紧|轻)?(皱|锁|蹙)", "expression"),
    ("眯起(了)?眼睛", "expression"),
    ("面无表情", "expression"),
    ("神色如常", "expression"),
    ("似笑非笑", "expression"),
    ("若有所思", "expression"),
    ("意味深长", "expression"),
    ("眼中闪过一丝(惊讶|喜色|寒意|狠色|黯然)", "expression"),
    ("眼底闪过", "expression"),
    ("瞳孔(骤|猛|微)?(缩|收缩)", "expression"),
    ("脸色(微变|一变|铁青|煞白|沉了下来)", "expression"),
    ("面沉如水", "expression"),
    ("玩味(地|的笑容|的眼神)?", "expression"),
    ("邪魅一笑", "expression"),
    ("扯了扯嘴角", "expression"),
    ("苦笑(一声|着)?", "expression"),
    ("笑而不语", "expression"),
    ("深吸一口气", "body"),
    ("呼吸(一滞|急促|乱了)", "body"),
    ("心跳(漏了半拍|漏了一拍|加速|骤然加快|如鼓)", "body"),
    ("(心|心头|心中)(一紧|一沉|一凛|一颤|咯噔一下)", "body"),
    ("手心(出汗|冒汗|沁出冷汗)", "body"),
    ("指尖(发白|微颤|冰凉)", "body"),
    ("指节(发白|泛白)", "body"),
    ("握紧(了)?拳头", "body"),
    ("指甲(掐进|嵌入|陷进)(了)?掌心", "body"),
    ("后背(发凉|一阵发凉|沁出冷汗)", "body"),
    ("脊背发凉", "body"),
    ("冷汗(直流|直冒|沁出|渗出)", "body"),
    ("如坠冰窟", "body"),
    ("一股寒意从脚底", "body"),
    ("毛骨悚然", "body"),
    ("头皮发麻", "body"),
    ("双腿(发软|一软)", "body"),
    ("浑身(一震|僵硬|紧绷)", "body"),
    ("喉咙(发紧|一紧|干涩)", "body"),
    ("鼻子一酸", "body"),
    ("眼眶(湿润|发红|一热)", "body"),
    ("眼泪(不受控制地|不由自主地|夺眶而出)", "body"),
    ("不由自主地", "body"),
    ("情不自禁", "body"),
    ("下意识(地)?", "body"),
    ("鬼使神差", "body"),
    ("五味杂陈", "emotion"),
    ("百感交集", "emotion"),
    ("复杂的情绪", "emotion"),
    ("说不出的滋味", "emotion"),
    ("莫名的(烦躁|恐慌|委屈|难过)", "emotion"),
    ("怒火中烧", "emotion"),
    ("一股无名火", "emotion"),
    ("气得浑身发抖", "emotion"),
    ("心中暗道", "emotion"),
    ("暗自思忖", "emotion"),
    ("一阵(酸涩|刺痛|悸动|失落)", "emotion"),
    ("胸口(一阵剧痛|发闷|像被压住)", "emotion"),
    ("心如刀绞", "emotion"),
    ("仿佛整个世界都(安静|静止|旋转)了", "simile"),
    ("空气(仿佛|似乎|好像)?(在这一刻)?凝固", "simile"),
    ("时间(仿佛|好像|似乎)?(静止|停滞|凝固)了", "simile"),
    ("整个世界都安静了", "simile"),
    ("仿佛过了(一个世纪|很久|漫长的瞬间)", "simile"),
    ("死一般的寂静", "simile"),
    ("犹如(晴天霹雳|雷击|噩梦)", "simile"),
    ("像被(雷劈|电击|击中)(了)?(一样)?", "simile"),
    ("如遭雷击", "simile"),
    ("仿佛被施了定身法", "simile"),
    ("像(被|被人)掐住了(脖子|喉咙)", "simile"),
    ("仿佛被抽空了(力气|所有)", "simile"),
    ("鸦雀无声", "atmosphere"),
    ("落针可闻", "atmosphere"),
    ("一片哗然", "atmosphere"),
    ("全场哗然", "atmosphere"),
    ("倒吸(了)?一口凉气", "atmosphere"),
    ("议论纷纷", "atmosphere"),
    ("炸开了锅", "atmosphere"),
    ("空气(突然|顿时|一下子)安静(下来|了)", "atmosphere"),
    ("淡淡(开口|说|道|回答)", "speech_tag"),
    ("缓缓(开口|说|道)", "speech_tag"),
    ("一字一顿", "speech_tag"),
    ("沉声(开口|说|道|问)", "speech_tag"),
    ("冷声(说|道|开口)", "speech_tag"),
    ("声音不大(，却)?", "speech_tag"),
    ("平静无波", "speech_tag"),
    ("语气(平淡|平静|冷淡|生硬)", "speech_tag"),
    ("顿了顿", "speech_tag"),
    ("沉吟(片刻|半晌)?", "speech_tag"),
    ("沉默(了)?(片刻|半晌|一会儿)", "speech_tag"),
    ("半晌(才)?", "speech_tag"),
    ("良久", "speech_tag"),
    ("片刻之后", "transition"),
    ("没过多久", "transition"),
    ("不一会儿", "transition"),
    ("就在这时", "transition"),
    ("下一秒", "transition"),
    ("说时迟那时快", "transition"),
    ("电光火石(之间|之际)", "transition"),
    ("千钧一发", "transition"),
    ("生死一线", "transition"),
    ("次日清晨", "transition"),
    ("第二天一早", "transition"),
    ("剑眉(星目|斜飞|入鬓)", "look"),
    ("(深邃|狭长|桃花|丹凤)(的)?眼(眸|神)", "look"),
    ("薄唇轻启", "look"),
    ("棱角分明的(脸|脸庞|下颌)", "look"),
    ("刀削般的(脸|脸庞|侧脸|轮廓)", "look"),
    ("肤若凝脂", "look"),
    ("明眸皓齿", "look"),
    ("清冷(的)?气质", "look"),
    ("绝美的容颜", "look"),
    ("美得不似(凡人|真人|人间)", "look"),
    ("目光如炬", "look"),
    ("鹰隼(般|一样|似的)(的)?(目光|眼神|眼睛)", "look"),
    ("钢铁般的(意志|眼神)", "look"),
    ("坚定(的)?(眼神|目光)", "look"),
    ("黑眸(深邃|如墨|幽深)", "look"),
]
#: (pattern, category, tier)
EXPLICIT_TERMS: list[tuple[str, str, str]] = [
    ("(该死|该死的)", "profanity", "mild"),
    ("(混账|混蛋|王八蛋|狗东西|畜生|狗屎)", "profanity", "mild"),
    ("(蠢货|白痴|废物|饭桶|窝囊废)", "profanity", "mild"),
    ("(他妈的|妈的|特么的|丫的)", "profanity", "moderate"),
    ("(不要脸|无耻|下贱|贱骨头)", "profanity", "moderate"),
    ("(傻逼|龟孙|狗娘养的|狗日的|杂种)", "profanity", "strong"),
    ("(我操|我艹|去他妈|你妈的|妈卖批)", "profanity", "strong"),
    ("(婊子|荡妇|骚货|破鞋|淫妇|贱货)", "hate", "strong"),
    ("(黑鬼|支那人|劣等民族|优等种族|人渣)", "hate", "strong"),
    ("(贱人|贱婢|下等人)", "hate", "moderate"),
    ("(残废|瘸子|瞎子|聋子)", "hate", "mild"),
    ("(接吻|亲吻|热吻|拥吻)", "sexual", "mild"),
    ("强吻", "sexual", "moderate"),
    ("(裸体|赤裸|一丝不挂)", "sexual", "moderate"),
    ("(脱衣|宽衣|解带|扒光)", "sexual", "moderate"),
    ("(巫山云雨|云雨巫山|鱼水之欢|周公之礼|春宵)", "sexual", "moderate"),
    ("(卖淫|嫖娼|妓院|窑子|狎妓|陪睡)", "sexual", "moderate"),
    ("(做爱|性交|性爱|口交|自慰|性高潮)", "sexual", "strong"),
    ("(阴茎|阴道|阴部|生殖器|性器|乳头|乳房|精液)", "sexual", "strong"),
    ("(强奸|性侵|轮奸|性骚扰|猥亵|乱伦)", "sexual_violence", "strong"),
    ("(迷奸|采花|逼奸)", "sexual_violence", "strong"),
    ("(打架|斗殴|推搡|扭打|耳光|拳打脚踢)", "violence", "mild"),
    ("(殴打|拷打|酷刑|虐待|流血|鲜血淋漓|砍杀|刺杀|枪杀)", "violence", "moderate"),
    ("(杀人|凶杀|谋杀|毒杀|虐杀|尸体|死尸|凶案)", "violence", "moderate"),
    ("(屠杀|灭口|分尸|碎尸|肢解|开膛|挖眼|割喉|斩首)", "violence", "strong"),
    ("(凌迟|剥皮|活埋|人彘|剁碎|血溅五步)", "violence", "strong"),
    ("(自杀|寻死|轻生|自我了断|自残|割腕|上吊|服毒|烧炭)", "self_harm", "strong"),
    ("(自杀未遂|企图自杀)", "self_harm", "strong"),
    ("(吞安眠药|大量服药|注射过量)", "self_harm", "strong"),
    ("(跳楼|坠楼)", "self_harm", "moderate"),
    ("(自焚|殉情|绝食)", "self_harm", "moderate"),
    ("(喝醉|烂醉|酗酒|买醉)", "substance", "mild"),
    ("灌醉", "substance", "moderate"),
    ("(鸦片|大烟|烟馆|鸦片烟)", "substance", "moderate"),
    ("(毒品|吸毒|贩毒|海洛因|冰毒|摇头丸|大麻|可卡因|吗啡|致幻剂|戒毒)", "substance", "strong"),
]
#: (model, beat, window from, window to, landmark kinds by preference)
BEATS: list[tuple[str, str, float, float, list[str]]] = [
    ("three_act", "setup", 0.00, 0.24, ["opening", "peak"]),
    ("three_act", "first_turn", 0.18, 0.38, ["turn", "peak"]),
    ("three_act", "midpoint", 0.42, 0.62, ["turn", "peak", "trough"]),
    ("three_act", "second_turn", 0.60, 0.80, ["turn", "peak"]),
    ("three_act", "climax", 0.76, 0.96, ["climax", "peak"]),
    ("three_act", "resolution", 0.90, 1.00, ["trough", "turn"]),
    ("kisho_tenketsu", "kisho", 0.00, 0.28, ["opening", "peak"]),
    ("kisho_tenketsu", "sho", 0.25, 0.52, ["peak", "turn"]),
    ("kisho_tenketsu", "ten", 0.50, 0.78, ["turn", "trough", "peak"]),
    ("kisho_tenketsu", "ketsu", 0.75, 1.00, ["trough", "climax", "peak"]),
    ("hero_journey", "ordinary_world", 0.00, 0.15, ["opening", "trough"]),
    ("hero_journey", "call", 0.08, 0.28, ["turn", "peak"]),
    ("hero_journey", "threshold", 0.22, 0.40, ["turn", "peak"]),
    ("hero_journey", "tests", 0.35, 0.62, ["peak", "turn"]),
    ("hero_journey", "inmost_cave", 0.58, 0.80, ["trough", "turn"]),
    ("hero_journey", "resurrection", 0.74, 0.92, ["peak", "climax", "turn"]),
    ("hero_journey", "return", 0.88, 1.00, ["trough", "turn"]),
]
