"""The bundled grammars: Python 3, and JavaScript modules with TypeScript as an extension.

They recognise, so operators have no precedence. `ASI` in the scripts' grammar is a semicolon, written or
inserted. Tokens in capitals come from the lexers in syntax_check; OBJ{, FUNX, CLSX are {, function and
class where an expression is expected and no statement can begin.
"""

PYTHON = r"""
file: stmt*
stmt: simple | compound
simple: small%; NEWLINE | small%; ; NEWLINE
small: exprs | assign | pass | break | continue | return exprs? | raise | raise expr | raise expr from expr | global NAMEX%, | nonlocal NAMEX%, | del exprs | assert expr | assert expr , expr | import dotted_as%, | from_import | type NAMEX tparams? = expr
assign: chain = value | exprs AUG value | target : expr | target : expr = value
chain: exprs | chain = exprs
target: primary
value: exprs | yield_expr
yield_expr: yield | yield exprs | yield from expr
dotted: NAMEX | dotted . NAMEX
dotted_as: dotted | dotted as NAMEX
from_import: from from_path import STAR | from from_path import name_as%, | from from_path import ( name_as%, ) | from from_path import ( name_as%, , )
from_path: dotted | dots | dots dotted
dots: . | ... | dots . | dots ...
name_as: NAMEX | NAMEX as NAMEX
compound: if_stmt | while named : block else_block? | for_stmt | try_stmt | with_stmt | func | classdef | match_stmt | decorator+ func | decorator+ classdef | async func | async for_stmt | async with_stmt | decorator+ async func
decorator: @ named NEWLINE
block: NEWLINE INDENT stmt+ DEDENT | simple
if_stmt: if named : block elif_block* else_block?
elif_block: elif named : block
else_block: else : block
for_stmt: for targets in exprs : block else_block?
targets: star_target%, | star_target%, ,
star_target: primary | STAR primary
try_stmt: try : block except_block+ else_block? finally_block? | try : block finally_block
except_block: except : block | except except_what : block | except STAR except_what : block
except_what: expr | expr as NAMEX
finally_block: finally : block
with_stmt: with with_item%, : block | with ( with_item%, ) : block | with ( with_item%, , ) : block
with_item: expr | expr as star_target
func: def NAMEX tparams? ( params? ) returns? : block
returns: -> expr
params: param%, | param%, ,
param: NAMEX annotation? default? | STAR NAMEX? star_annotation? | ** NAMEX annotation? | /
annotation: : expr
star_annotation: : star_expr
default: = expr
tparams: [ tparam%, ] | [ tparam%, , ]
tparam: NAMEX annotation? default? | STAR NAMEX default? | ** NAMEX default?
classdef: class NAMEX tparams? : block | class NAMEX tparams? ( args? ) : block
match_stmt: match exprs : NEWLINE INDENT case_block+ DEDENT
case_block: case patterns guard? : block
guard: if named
patterns: pattern_as%, | pattern_as%, ,
pattern_as: pattern | pattern as NAMEX
pattern: pattern_one | pattern OR pattern_one
pattern_one: literal | dotted | STAR NAMEX | dotted ( ) | dotted ( pattern_arg%, ) | dotted ( pattern_arg%, , ) | ( ) | ( patterns ) | [ ] | [ patterns ] | { } | { pattern_item%, } | { pattern_item%, , }
pattern_arg: pattern_as | NAMEX = pattern_as
pattern_item: literal : pattern_as | dotted : pattern_as | ** NAMEX
literal: STRING+ | number | None | True | False
number: NUMBER | PM NUMBER | NUMBER PM NUMBER | PM NUMBER PM NUMBER
exprs: star_expr%, | star_expr%, ,
star_expr: named | STAR binary
named: expr | NAMEX := expr
expr: disjunction | disjunction if disjunction else expr | lambda lambda_params? : expr
lambda_params: lambda_param%, | lambda_param%, ,
lambda_param: NAMEX default? | STAR NAMEX? | ** NAMEX | /
disjunction: inversion | disjunction and inversion | disjunction or inversion
inversion: comparison | not inversion
comparison: binary | comparison comp binary
comp: CMP | in | not in | is | is not
binary: unary | binary binop unary
binop: PM | STAR | ** | / | OP | OR | @
unary: primary_await | PM unary | ~ unary
primary_await: primary | await primary
primary: atom | primary . NAMEX | primary ( args? ) | primary [ slices ]
args: arg%, | arg%, ,
arg: named | named comp_for+ | NAMEX = expr | STAR expr | ** expr
slices: slice%, | slice%, ,
slice: named | STAR binary | expr? : expr? | expr? : expr? : expr?
atom: NAMEX | NUMBER | STRING+ | ... | None | True | False | ( ) | ( exprs ) | ( yield_expr ) | ( star_expr comp_for+ ) | [ ] | [ exprs ] | [ star_expr comp_for+ ] | { } | { exprs } | { star_expr comp_for+ } | { dict_item%, } | { dict_item%, , } | { expr : expr comp_for+ }
dict_item: expr : expr | ** binary
comp_for: for targets in disjunction comp_if* | async for targets in disjunction comp_if*
comp_if: if comp_cond
comp_cond: disjunction | NAMEX := disjunction
NAMEX: NAME | match | case | type
"""

SCRIPT = r"""
program: item*
item: stmt | import_decl | export_decl
import_decl: import STR attrs? ASI | import clause from STR attrs? ASI
clause: ident | star_as | named_imports | ident , star_as | ident , named_imports
star_as: * as ident
named_imports: { } | { import_spec%, } | { import_spec%, , }
import_spec: ident | name as ident | STR as ident
attrs: with OBJ
OBJ: OBJ{ } | OBJ{ prop%, } | OBJ{ prop%, , }
export_decl: decorator+ export class_decl | decorator+ export default class_default | export * from STR attrs? ASI | export * as name from STR attrs? ASI | export named_exports from STR attrs? ASI | export named_exports ASI | export decl | export var_stmt | export default func_default | export default class_default | export default assign ASI
named_exports: { } | { export_spec%, } | { export_spec%, , }
export_spec: name | name as name | STR
func_default: func_decl | function gen? sig block | async function gen? sig block
class_default: class_decl | class heritage? class_body | decorator+ class heritage? class_body
decl: func_decl | class_decl
stmt: block | var_stmt | EMPTYSTMT | expr_stmt | if ( expr ) stmt | if ( expr ) stmt else stmt | do stmt while ( expr ) ASI | do stmt while ( expr ) | while ( expr ) stmt | for_stmt | continue ident? ASI | break ident? ASI | return expr? ASI | switch_stmt | ident : stmt | throw expr ASI | try_stmt | debugger ASI | decl
EMPTYSTMT: ;
ASI: ; | VSEMI
expr_stmt: expr ASI
block: { stmt* }
var_stmt: vopen declarator%, ASI | const constant%, ASI
vopen: var | let
vkind: var | let | const
constant: binding init
declarator: binding init?
init: = assign
for_stmt: for ( for_init? ; expr? ; expr? ) stmt | for await? ( for_head in expr ) stmt | for await? ( for_head of assign ) stmt
for_init: vopen declarator%, | const constant%, | expr
for_head: vkind binding | postfix
switch_stmt: switch ( expr ) { case_clause* }
case_clause: case expr : stmt* | default : stmt*
try_stmt: try block catch_part | try block finally_part | try block catch_part finally_part
catch_part: catch block | catch ( binding ) block
finally_part: finally block
binding: ident | bpattern
bpattern: [ elements? ] | OB bprops? CB
OB: OBJ{
CB: }
elements: elisions | elements_some elisions?
elements_some: elisions? element | elements_some , elisions? element
elisions: , | elisions ,
element: binding init? | ... binding
bprops: bprop%, | bprop%, ,
bprop: ident init? | key : binding init? | ... binding
gen: *
func_decl: function gen? ident sig block | async function gen? ident sig block
sig: ( params? )
params: param%, | param%, ,
param: binding init? | ... binding
class_decl: class ident heritage? class_body | decorator+ class ident heritage? class_body
heritage: extends postfix
class_body: { member* }
member: ; | decorator* static? method | decorator* static? field ASI | static block
method: gen? key sig block | async gen? key sig block | get key sig block | set key sig block
field: key init?
decorator: @ postfix_deco
postfix_deco: ident | postfix_deco . name | postfix_deco ( args? ) | ( expr )
key: name | STR | NUM | PRIVATE | [ assign ]
expr: assign | expr , assign
assign: cond | postfix aop assign | pattern_literal aop assign | arrow | async arrow | yield | yield assign | yield * assign
aop: = | ASSIGN
pattern_literal: array | object
arrow: ident ARROW arrow_body | sig ARROW arrow_body
arrow_body: assign | block
cond: binary | binary ? assign : assign
binary: operand | binary binop operand | PRIVATE in operand
binop: ADD | * | / | OP | BAR | AMP | < | > | > GTA | > GTA GTA | in | instanceof
operand: postfix | array | object | prefix operand | update
prefix: ADD | ! | ~ | typeof | void | delete | await
update: postfix INC | INC operand | INCNL operand
postfix: primary | postfix . name | postfix . PRIVATE | postfix OPTDOT name | postfix OPTDOT PRIVATE | postfix OPTDOT ( args? ) | postfix OPTDOT [ expr ] | postfix [ expr ] | array [ expr ] | array . name | object . name | object [ expr ] | postfix ( args? ) | postfix template | new_expr
new_expr: new callee ( args? ) | new callee | new . name
callee: primary | callee . name | callee . PRIVATE | callee [ expr ] | new_expr
args: arg%, | arg%, ,
arg: assign | ... assign
primary: ident | this | super | null | true | false | NUM | STR | REGEX | template | ( expr ) | func_expr | class_expr | import_call
import_call: import ( assign ) | import ( assign , assign ) | import . name
func_expr: FUNX gen? ident? sig block | async FUNX gen? ident? sig block
class_expr: CLSX ident? heritage? class_body
template: TEMPLATE | THEAD template_rest
template_rest: expr TTAIL | expr TMID template_rest
array: [ ] | [ array_items ] | [ array_items , ] | [ array_items elisions2 ] | [ elisions ]
elisions2: , elisions
array_items: elisions? arg | array_items , elisions? arg
object: OBJ{ } | OBJ{ prop%, } | OBJ{ prop%, , }
prop: key : assign | ident init? | method | ... assign
ident: NAME | CONTEXT
name: ident | RESERVED
CONTEXT: async | of | get | set | from | as | type | declare | namespace | module | abstract | readonly | keyof | unique | infer | is | asserts | satisfies | require | global | override | accessor | out
RESERVED: await | break | case | catch | class | const | continue | debugger | default | delete | do | else | export | extends | false | finally | for | function | if | import | in | instanceof | new | null | return | super | switch | this | throw | true | try | typeof | var | void | while | with | yield | let | static | enum | STRICT
STRICT: implements | interface | package | private | protected | public
"""

TYPESCRIPT = r"""
decl: abstract_class | interface_decl | alias_decl | enum_decl | namespace_decl | declare_decl | func_decl_head
stmt: decl
ident: STRICTX
STRICTX: implements | package | interface | private | protected | public
import_decl: import type clause from STR attrs? ASI | import ident = require ( STR ) ASI | import type ident = require ( STR ) ASI | import ident = entity ASI
export_decl: decorator+ export abstract_class | decorator+ export default abstract_class | export type named_exports from STR attrs? ASI | export type named_exports ASI | export type * from STR ASI | export type * as name from STR ASI | export = expr ASI | export as namespace ident ASI | export import ident = entity ASI | export default interface_decl | export default abstract_class | export default function sig returns? ASI
import_spec: type ident | type name as ident
export_spec: type name | type name as name
abstract_class: abstract class_decl | decorator+ abstract class_decl
class_decl: class ident tparams heritage? class_body | decorator+ class ident tparams heritage? class_body
class_expr: CLSX ident? tparams heritage? class_body
heritage: extends postfix targs | extends postfix implements_part | extends postfix targs implements_part | implements_part
implements_part: implements tref%,
interface_decl: interface ident tparams? object_type | interface ident tparams? extends tref%, object_type
alias_decl: type ident tparams? = type_ ASI
enum_decl: enum ident enum_body | const enum ident enum_body
enum_body: { } | { enum_member%, } | { enum_member%, , }
enum_member: key init?
namespace_decl: namespace entity ns_body | module entity ns_body | module STR ns_body | global ns_body
ns_body: { item* }
declare_decl: declare decl | declare var_stmt | declare module STR ASI
func_decl_head: function gen? ident sig ASI | async function gen? ident sig ASI
sig: tparams ( params? ) returns? | ( params? ) returns
returns: : return_type
return_type: type_ | asserts ident | asserts this | asserts ident is type_ | ident is type_ | this is type_
param: decorator* modifier* binding opt? annotation? init? | decorator* modifier* ... binding annotation? | this annotation
opt: ?
modifier: public | private | protected | readonly | override | static | abstract | declare | accessor
annotation: : type_
declarator: binding annotation init? | binding ! annotation
constant: binding annotation init?
catch_part: catch ( binding annotation ) block
for_head: vkind binding annotation
member: decorator* modifier+ method | decorator* modifier+ field ASI | decorator* modifier* method_head ASI | modifier* index_signature ASI
method: gen? key opt sig block
method_head: gen? key opt? sig | async gen? key opt? sig | get key sig | set key sig
field: key opt annotation? init? | key ! annotation init? | key annotation init?
index_signature: [ ident : type_ ] annotation
operand: < type_ > operand
binary: binary as type_ | binary as const | binary satisfies type_
postfix: postfix ! | postfix targs ( args? ) | postfix OPTDOT targs ( args? ) | postfix targs template
new_expr: new callee targs ( args? ) | new callee targs
pattern_literal: pattern_literal as type_
targs: < type_%, close
close: > | GTA
tparams: < tparam%, close | < tparam%, , close
tparam: tmods* ident extends_type? default_type?
tmods: const | in | out
extends_type: extends type_
default_type: = type_
type_: union | union extends union ? type_ : type_ | function_type
function_type: ( params? ) ARROW return_type | tparams ( params? ) ARROW return_type | new ( params? ) ARROW type_ | new tparams ( params? ) ARROW type_ | abstract new ( params? ) ARROW type_
union: intersection | union BAR intersection | BAR intersection
intersection: unary_type | intersection AMP unary_type | AMP unary_type
unary_type: post_type | keyof unary_type | unique unary_type | readonly unary_type | infer ident | infer ident extends_type | typeof entity targs? | typeof import_type
post_type: prim_type | post_type [ ] | post_type [ type_ ]
prim_type: tref | STR | NUM | ADD NUM | template_type | null | void | this | true | false | ( type_ ) | [ ] | [ tuple_item%, ] | [ tuple_item%, , ] | object_type | mapped_type | import_type
import_type: import ( STR ) | import ( STR ) . entity | import ( STR ) . entity targs
tref: entity targs?
entity: ident | entity . name | this . name
template_type: TEMPLATE | THEAD template_type_rest
template_type_rest: type_ TTAIL | type_ TMID template_type_rest
tuple_item: type_ opt? | ... type_ | ident opt? : type_ | ... ident : type_
object_type: OB CB | OB type_members CB | OB type_members type_sep CB
type_members: type_member | type_members type_sep type_member
type_sep: ; | , | VSEMI
type_member: tm_mod* key opt? annotation? | tm_mod* key opt? sig | sig | new sig | get key sig | set key sig | tm_mod* index_signature
tm_mod: readonly
mapped_type: OB mapped_mod? [ ident in type_ as_part? ] mapped_opt? annotation? type_sep? CB
as_part: as type_
mapped_mod: readonly | ADD readonly
mapped_opt: ? | ADD ?
"""
