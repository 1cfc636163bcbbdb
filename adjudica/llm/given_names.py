"""Given names by which names are found in text, apart from those that serve as surrogates."""

# Common given names by gender. Words that often start a sentence (May, Will, Mark) are left out.
DETECTED = {
    "f": """Abigail Adela Adele Adriana Agatha Agnes Agnieszka Aisha Alba Alejandra Alessandra Alexandra Alexandria Alexia
Alice Alicia Alina Alison Allison Alma Amalia Amanda Amelia Amélie Amina Amira Amy Ana Anaïs Anastasia Andrea Andrée Angela
Angelica Angelina Angélique Anita Anja Anke Ann Anna Annabelle Anne Annette Annika Antje Antoinette Antonia Araceli Ariana Ashley
Astrid Audrey Aurélie Aurora Ava Barbara Beate Beatrice Beatriz Begoña Bernadette Bertha Bettina Betty Beverly Bianca Birgit Blanca
Brenda Brigitte Britta Camila Camille Carla Carlotta Carmen Carol Carolina Caroline Carolyn Catalina Catherine Cathy Cecilia Céline
Chantal Charlotte Cheryl Chiara Chloe Chloé Christa Christelle Christiane Christina Christine Cindy Claire Clara Claudia Clémence
Clementine Concepción Constance Consuelo Corinna Corinne Cornelia Cristina Cynthia Dagmar Daniela Danielle Deborah Delphine Denise
Diana Diane Dolores Donna Dora Doris Dorothea Dorothy Edith Eileen Elaine Eleanor Elena Elisa Elisabeth Élise Elizabeth Elke Ella
Ellen Élodie Elsa Elvira Emilia Émilie Emily Emma Erika Esperanza Estelle Esther Eugenia Eva Evelyn Fabienne Fatima Fátima Fiona
Florence Frances Francesca Françoise Franziska Frida Frieda Gabriela Gabriele Gabrielle Gemma Geneviève Georgia Gerda Gertrud Gisela
Giulia Gloria Greta Guadalupe Gudrun Hannah Hanna Hannelore Heather Heidi Heike Helen Helena Helene Hélène Helga Henriette Hilda
Hildegard Ida Ilse Imogen Ines Inés Inge Ingrid Irene Irina Iris Irma Isabel Isabella Isabelle Jacqueline Jana Jane Janet Janice
Jasmin Jeanne Jennifer Jessica Jimena Joan Joanna Johanna Josefina Joséphine Joyce Juana Judith Judy Julia Juliana Julie Juliette
Justine Jutta Karen Karin Karina Karla Katharina Katherine Kathleen Kathrin Kathryn Katja Katrin Kelly Kerstin Kimberly Kirsten Klara
Lara Larissa Laura Laure Lauren Lea Léa Leila Lena Leonie Leonor Leticia Lieselotte Lilian Lina Linda Lisa Liselotte Lola Lorena
Louise Lourdes Lucia Lucía Lucie Lucy Luisa Luise Luz Lydia Madeleine Magali Magdalena Manon Manuela Mara Marcela Margaret Margarita
Margarete Margot Marguerite Maria María Mariana Marianne Marie Marina Marion Marisol Marlene Marta Martha Martina Martine Mary
Mathilde Matilda Maureen Megan Melanie Mélanie Melissa Mercedes Mia Michaela Michelle Mina Miranda Miriam Monica Mónica Monika
Monique Montserrat Nadia Nadine Nadja Nancy Natalia Natalie Nathalie Nicole Nina Noelia Noémie Nora Nuria Odette Olga Olivia Pamela
Paola Patricia Paula Paulina Pauline Penelope Petra Phoebe Pilar Priscilla Rachel Raquel Rebeca Rebecca Regina Renata Renate Renée
Rita Roberta Rocío Romy Rosa Rosalie Rosario Rosemary Roxane Ruth Sabine Sabrina Samantha Sandra Sara Sarah Sharon Sheila Shirley
Sibylle Silke Silvia Simone Sofia Sofía Solange Sonia Sonja Sophia Sophie Stefanie Stella Stephanie Stéphanie Susan Susana Susanne
Suzanne Svenja Sylvia Sylvie Tamara Tanja Tatiana Teresa Theresa Thérèse Tiffany Tina Ulrike Ursula Uta Valentina Valeria Valérie
Vanessa Vera Veronica Verónica Véronique Victoria Viktoria Violeta Virginia Virginie Vivian Viviane Wendy Wilhelmina Ximena Yolanda
Yvonne Zoe Zoé
Александра Алёна Алина Алла Анастасия Ангелина Анжела Анна Антонина Валентина Валерия Варвара Вера Вероника Виктория Галина Дарья
Диана Евгения Екатерина Елена Елизавета Жанна Зинаида Зоя Инна Ирина Карина Кира Клавдия Кристина Ксения Лариса Лидия Людмила
Маргарита Марина Мария Надежда Наталия Наталья Нина Оксана Олеся Ольга Полина Раиса Регина Светлана Серафима София Софья Таисия
Тамара Татьяна Ульяна Юлия Яна""",
    "m": """Aaron Abdul Abraham Adam Adrian Adrián Adrien Ahmed Alain Alan Albert Alberto Alejandro Alessandro Alex Alexander
Alexandre Alexis Alfonso Alfred Alfredo Ali Álvaro Andreas André Andrés Andrew Ángel Anthony Antoine Anton Antonio Armando Arnaud
Arnold Arthur Arturo Aurélien Axel Baptiste Bartholomew Bastian Benedikt Benjamin Benoît Bernard Bernd Bernhard Björn Boris Brandon
Brian Bruce Bruno Bryan Camilo Carl Carlo Carlos Carsten Cédric César Charles Christoph Christophe Christopher Claude Claudio Clemens
Clément Craig Cristian Cristóbal Curtis Cyril Damien Daniel Darío David Dennis Derek Detlef Didier Diego Dieter Dietrich Dirk
Domingo Dominik Dominique Donald Douglas Dylan Eberhard Edgar Edmund Eduardo Edward Edwin Egon Elias Emanuel Emil Émile Emiliano
Emilio Emmanuel Enrique Éric Eric Erich Erik Ernesto Ernst Esteban Étienne Eugen Eugene Eugenio Fabian Fabien Fabrice Federico Felipe
Felix Félix Ferdinand Fernando Florent Florian Francesco Francis Francisco Franck François Frank Franz Fred Frédéric Frederick
Friedrich Fritz Gabriel Gary Gaspard Georg George Georges Gerald Gérard Gerardo Gerd Gerhard Germán Gilbert Gilles Giovanni Giuseppe
Gonzalo Gottfried Gregor Gregory Grégoire Guido Guillaume Guillermo Gunther Günter Gustav Gustavo Guy Hans Harald Harold Harry Hassan
Hector Héctor Heiko Heinrich Heinz Helmut Henri Henrik Henry Herbert Hermann Horst Howard Hubert Hugo Ian Ibrahim Ignacio Igor Ingo
Isaac Ismael Iván Jaime Jack Jacob Jacques Jakob James Jan Jason Javier Jean Jeffrey Jens Jeremy Jérémy Jérôme Jerry Jesse Jesús Joachim
Joaquín Joel Joël Johann Johannes John Jonas Jonathan Jörg Jorge José Josef Joseph Joshua Juan Jules Julian Julien Julio Jürgen Justin
Kai Karl Karsten Keith Kenneth Kevin Klaus Konrad Konstantin Kurt Kyle Lars Laurent Lawrence Leandro Léon Leon Leonard Leonardo Leopold
Lorenzo Lothar Louis Luc Luca Lucas Lucien Ludwig Luis Lukas Luke Lutz Manfred Manuel Marc Marcel Marcelo Marco Marcos Marcus Mario
Markus Martin Martín Mateo Mathias Mathieu Mathis Matías Matteo Matthew Matthias Maurice Mauricio Max Maxime Maximilian Michael Michel
Miguel Mohamed Mohammed Moritz Mustafa Nathan Nathaniel Nicholas Nicolas Nicolás Niklas Nikolaus Nils Noah Noel Norbert Norman Octavio
Olaf Oliver Olivier Omar Oscar Óscar Oskar Oswald Otto Pablo Pascal Patrice Patrick Patricio Paul Paulo Pedro Peter Philip Philipp
Philippe Pierre Quentin Rafael Rainer Ralf Ralph Ramiro Ramón Randy Raphael Raphaël Raúl Raymond Reinhard Rémi Renaud René Ricardo
Richard Robert Roberto Robin Rodolfo Rodrigo Roger Roland Rolf Roman Ronald Rubén Rudolf Rüdiger Russell Ryan Salvador Samuel Samir
Santiago Scott Sean Sébastien Sebastian Sergio Siegfried Simon Stefan Stefano Stephan Stéphane Stephen Steven Stuart Sven Sylvain Tariq
Terry Theodor Theodore Théo Thibault Thierry Thomas Thorsten Tim Timothy Tobias Todd Tomás Torsten Tristan Tyler Udo Ulrich Uwe
Valentin Vicente Victor Víctor Viktor Vincent Vincenzo Volker Walter Werner Wilfried Wilhelm Willem William Wolfgang Wolfram Xavier
Yann Yannick Yusuf Yves Zacharie
Александр Алексей Анатолий Андрей Антон Аркадий Арсений Артём Артур Борис Вадим Валентин Валерий Василий Виктор Виталий Владимир
Владислав Всеволод Вячеслав Геннадий Георгий Герман Глеб Григорий Даниил Денис Дмитрий Евгений Егор Иван Игорь Илья Кирилл Константин
Леонид Максим Марк Матвей Михаил Никита Николай Олег Павел Пётр Роман Ростислав Руслан Семён Сергей Станислав Степан Тимофей Тимур
Фёдор Филипп Эдуард Юрий Яков Ярослав""",
}
